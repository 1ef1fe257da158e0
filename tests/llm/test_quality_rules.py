import random
import re
from collections import Counter

from pyspark.sql import functions as F

from barloom.llm import quality_rules as q


def brute(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    at = {i + k for i, t in enumerate(tri) if c[t] > 1 for k in range(3)}
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(at)


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a a a", "x|y <z>\n\nx|y <z>\n \n", "é ß d\x0be", "w " * 3000, "  a b", "one two three four one two three five"]


def test_stats_match_brute_force(make_docs):
    r = random.Random(2)
    texts = [*enumerate(TEXTS)] + [(100 + k, " ".join(r.choice("abc#|") for _ in range(r.randint(0, 40)))) for k in range(60)] + [(None, "null id"), (3, "a")]
    want = Counter((d, *brute(t)) for d, t in texts)
    got = Counter((x.doc_id, *[x[c] for c in q.BASE]) for x in q.text_stats(make_docs(texts)).collect())
    assert got == want


def test_learns_separating_rules(spark, make_docs):
    r = random.Random(3)
    good = [(k, " ".join(f"w{r.randint(0, 5000)}" for _ in range(80))) for k in range(120)]
    bad = [(200 + k, " ".join(f"w{r.randint(0, 5000)}###" for _ in range(80))) for k in range(60)]
    shout = [(300 + k, " ".join(f"W{r.randint(0, 5000)}QX!" for _ in range(80))) for k in range(60)]
    docs = make_docs(good + bad + shout)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad + shout] + [(1, None), (None, 0)], "doc_id long, quality int")
    out, rules = q.judge(docs, labels)
    rows = {x.doc_id: x for x in out.collect()}
    assert 1 <= len(rules.rules) <= 8 and all("->" in str(x) for x in rules.rules)
    assert all(rows[i].kept for i, _ in good) and not any(rows[i].kept for i, _ in bad + shout)
    again, same = q.judge(docs.repartition(3), labels)
    assert same.rules == rules.rules
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in good}


def test_verdict_is_the_first_rule_that_fires_and_rules_hold_on_held_rows(spark, make_docs):
    """The verdict against plain Python over brute-force statistics, and the list against its own contract."""
    r = random.Random(5)
    texts = [(k, " ".join(r.choice(["Word", "w#rd", "wörd!", "12", "|"]) + str(r.randint(0, 900)) for _ in range(r.randint(30, 120)))) for k in range(400)]
    share = lambda t: t.count("#") / max(1, len(t.split()))
    labels = spark.createDataFrame([(k, int(share(t) < 0.2)) for k, t in texts if k % 2] + [(3, 0), (3, 1), (5, 7)], "doc_id long, quality int")
    out, rules = q.judge(make_docs(texts), labels)
    assert rules.rules and all(x.covered >= 0.9 * (x.covered + x.wrong) for x in rules.rules)
    for row, text in ((x, dict(texts)[x.doc_id]) for x in out.collect()):
        n, chars, symbols, _, repeats = brute(text)
        stats = row.asDict() | {"symbol_share": symbols / n, "mean_word": chars / n}
        fires = [k for k, rule in enumerate(rules.rules, 1) if all((stats[c.feature] > c.threshold) == c.above for c in rule.conditions)]
        assert row.rule == (fires[0] if fires else 0)
        assert row.base_failed == (n < 50 or 100 * repeats > 50 * n) and row.kept == (not row.base_failed and not fires)
    rejected = [share(dict(texts)[x.doc_id]) >= 0.2 for x in out.collect() if x.doc_id % 2 == 0 and x.rule]
    assert len(rejected) >= 10 and sum(rejected) >= 0.8 * len(rejected)  # rows that taught nothing


def test_ids_of_any_name_and_type(spark):
    docs = spark.createDataFrame([("a", "word " * 60, 1), ("b", None, 2), (None, "x y z", 3)], "t string, text string, w int")
    labels = spark.createDataFrame([("a", 1)], "t string, quality int")
    out, _ = q.judge(docs, labels, "t")
    assert sorted((x.t or "", x.n_words) for x in out.collect()) == [("", 3), ("a", 60), ("b", 0)]
    assert q.keep_good(docs, labels, "t").columns == ["t", "text", "w"]


def test_without_labels_and_without_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out, rules = q.judge(make_docs([(1, "word " * 10), (2, None)]), none)
    assert rules.rules == () and [r.base_failed for r in out.collect()] == [True, True]
    assert q.judge(make_docs([]), none)[0].count() == 0 and q.keep_good(make_docs([]), none).count() == 0


def test_rules_do_not_depend_on_partitioning(spark):
    x = lambda k: (F.xxhash64(F.lit(k), "id").bitwiseAND(0xFFFFF) / 1000.0)
    rows = spark.range(60_000).select("id", x(1).alias("a"), x(2).alias("b"), (x(3) - 300).alias("c"))
    rows = rows.withColumn("y", ((F.col("a") < 700) | (F.col("b") > 200) | (x(4) < 100)).cast("int"))
    lists = [q.learn(rows.repartition(n), "y", "id", ["a", "b", "c"]).rules for n in (1, 3, 16)]
    assert lists[0] and lists[0] == lists[1] == lists[2]


def test_cuts_are_quantiles(spark):
    r = random.Random(1)
    values = [(k % 2, r.choice([0.0, -3.0, 1.0, 2.0, r.lognormvariate(0, 3)])) for k in range(4000)]
    cuts = q._cuts(spark.createDataFrame(values, "y int, f double").repartition(5), "y", ["f"], 8)[0]
    want = []
    for y in (0, 1):
        mine = sorted(v for k, v in values if k == y)
        want += [mine[max(0, -(-(2 * k + 1) * len(mine) // 16) - 1)] for k in range(8)]
    assert set(cuts) <= {v for _, v in values} and len(cuts) <= 16
    assert all(min(abs(c - w) for c in cuts) <= 0.02 * max(0.0, w) or w <= 0 for w in want)
