import collections
import random
import re

import pytest
from conftest_llm import EDGES, prose, words

from topicdrift.llm import quality_rules, url_reputation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_base_counts(make):
    rng = random.Random(1)
    rows = EDGES + [(30 + i, "".join(rng.choice(["a ", "b ", "c.\n", "#* ", "|\t", "\n", "é<> "]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(300, " ".join(["w x y z q"] * 2)), (301, "only four words here"), (302, "1 2 3 4 5 6 1 2 3 4 5 7")]
    expected = []
    for i, text in rows:
        t, w = text or "", words(text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        times, covered = collections.Counter(grams), set()
        for k, gram in enumerate(grams):
            if times[gram] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        expected.append((repr(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    found = quality_rules.judged(make(rows))
    assert not re.search("Python|Arrow|Pandas|Exchange hash", plan(found))
    got = found.collect()
    assert sorted((repr(r.id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(expected)
    assert not any(r.kept for r in got if r.base_failed)


def test_lines(make):
    good = "This is a plain sentence, which ends as sentences do. " + prose(1, 15) + "."
    rows = [
        (1, good + "\n" + prose(2, 25) + "!"), (2, "Home | About | Contact | Login\n" + good), (3, "A | b | c | d | e | f | g | h | i | j |"),
        (4, "ALL OF THIS IS SHOUTED FAR TOO LOUDLY BY SOMEBODY!"), (5, "we use cookies to make this page better for you.\nyes."),
        (6, "a### b*** c$$$ d%%% e&&& f### g*** h$$$ i%%% j&&&."), (7, good + " And more. It was cut off in the middle of a"),
        (8, "no stop at the end of this line at all here"),
    ]
    found = {r.id: r for r in quality_rules.judged(make(rows)).collect()}
    assert {i for i in found if found[i].kept} == {1, 2, 7}
    assert found[2].clean == good and found[1].clean == rows[0][1]
    assert quality_rules.judged(make(rows).limit(0)).count() == 0


URLS = [
    ("http://Ab.Example.NET/en/x?y#z", "ab.example.net", "/en/x", "example.net/en/"), ("x://example.net/de/", "example.net", "/de/", "net/"),
    ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None),
    ("https://a.org/fr/", "a.org", "/fr/", "org/fr/"), ("https://a.org/fr", "a.org", "/fr", None), ("http://b.net", "b.net", "", None),
    ("http://b.net?q=/en/", "b.net", "", None), ("http://É.org#f", "É.org", "", None), ("no scheme", "", "", None), (None, "", "", None),
    ("a://b://c/d", "b:", "//c/d", None), ("", "", "", None), ("http:///p", "", "/p", None), ("http://x.net/\nq", "x.net", "/\nq", "net/"),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, url, "h", "n", 1.0) for i, url in rows], "page_id long, url string, host string, domain string, n double")


def test_hosts_paths_and_rules(spark):
    rows = [(i, u) for i, (u, *_) in enumerate(URLS)] + [(None, "http://q.net/"), (3, URLS[3][0])]
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = url_reputation.judged(pages(spark, rows), labels)
    assert not re.search("Python|Arrow|Pandas", plan(got))
    found = sorted(((r.page_id, r.host, r.path, r.rule) for r in got.collect()), key=repr)
    expected = [(i, *URLS[i][1:]) if i is not None else (None, "q.net", "/", "net/") for i, _ in rows]
    assert found == sorted(expected, key=repr)
    assert {r.verdict for r in got.where("rule = 'net/'").collect()} == {"block"}
    assert {r.verdict for r in got.where("rule in ('org/fr/', 'example.net/en/')").collect()} == {"allow"}
    assert url_reputation.judged(pages(spark, rows).limit(0), labels).count() == 0
    assert url_reputation.judged(pages(spark, rows), labels.limit(0)).count() == len(rows)


def test_reputation_shrinks_and_bounds(spark):
    rows = [(i, f"http://bad.one.com/{i}") for i in range(40)] + [(100 + i, f"http://good{i % 5}.two.com/{i}") for i in range(200)]
    rows += [(400, "http://few.two.com/"), (401, "http://few.one.com/"), (500, "http://new.one.com/"), (501, "http://new.two.com/")]
    labels = [(i, 0 if i < 38 or i in (400, 401) or 100 <= i < 106 else 1, 0) for i, _ in rows if i < 500]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.host: r for r in url_reputation.reputations(pages(spark, rows), table).collect()}
    assert found["bad.one.com"].n == 40 and found["bad.one.com"].bad == 38 and found["bad.one.com"].lower > 0.5
    assert found["good1.two.com"].rate < 0.2
    assert found["few.two.com"].rate < found["few.one.com"].rate < 1 and found["few.two.com"].lower < 0.5
    assert found["new.two.com"].rate < found["few.two.com"].rate and found["new.two.com"].rate < found["new.one.com"].rate
    verdicts = {r.host: r.verdict for r in url_reputation.judged(pages(spark, rows), table).select("host", "verdict").distinct().collect()}
    assert verdicts["bad.one.com"] == "block" and verdicts["good1.two.com"] == verdicts["few.two.com"] == "allow"


@pytest.mark.parametrize("rows", [[], [(1, "http://a.com/")]])
def test_single_groups(spark, rows):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert url_reputation.judged(pages(spark, rows), labels).count() == len(rows)


HOSTS = {
    "a.co.uk": ("co.uk", "a.co.uk"), "x.y.a.co.uk": ("co.uk", "a.co.uk"), "co.uk": ("co.uk", "co.uk"), "b.uk": ("uk", "b.uk"),
    "www.c.com": ("com", "c.com"), "d.e.f.kobe.jp": ("f.kobe.jp", "e.f.kobe.jp"), "notco.uk": ("uk", "notco.uk"), "localhost": ("localhost", "localhost"), "": ("", ""),
}


def test_suffixes_of_several_labels(spark):
    hosts = spark.createDataFrame([(host, i) for i, host in enumerate(HOSTS)], "host string, n int")
    table = spark.createDataFrame([("co.uk", 1), (" Co.Uk ", 2), ("uk", 3), (".f.kobe.jp", 4), ("kobe.jp", 5), (None, 6), ("", 7)], "suffix string, host int")
    named = url_reputation.with_domains(hosts, table)
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan(named))
    assert {r.host: (r.suffix, r.domain) for r in named.collect()} == HOSTS
    for few in (None, table.limit(0)):
        found = {r.host: (r.suffix, r.domain) for r in url_reputation.with_domains(hosts, few).collect()}
        assert found["x.y.a.co.uk"] == ("uk", "co.uk") and found["www.c.com"] == ("com", "c.com")


def test_neighbours_under_a_public_suffix_are_apart(spark):
    rows = [(i, f"http://h{i % 9}.bad.co.uk/") for i in range(90)] + [(100 + i, f"http://h{i % 9}.good.co.uk/") for i in range(90)] + [(500, "http://new.bad.co.uk/"), (501, "http://new.good.co.uk/")]
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i, _ in rows if i < 500], "doc_id long, quality int, toxic int")
    suffixes = spark.createDataFrame([("co.uk",)], "suffix string")

    def verdicts(*more):
        return {r.host: r.verdict for r in url_reputation.judged(pages(spark, rows), labels, (), *more).collect()}

    assert verdicts(suffixes)["new.bad.co.uk"] == "block" and verdicts(suffixes)["new.good.co.uk"] == "allow"
    assert verdicts()["new.bad.co.uk"] == verdicts()["new.good.co.uk"]
