import hashlib
import random
import re

from pyspark.sql import functions as F

from barloom.llm.line_dedup import LineRuns, dedup_lines

WS = " \t\n\x0b\x0c\r"


def brute(texts, least=10):
    key = lambda x: x.strip(WS).translate({c: c + 32 for c in range(65, 91)})
    owner = {}
    for d, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                owner.setdefault(key(x), d)
    out = []
    for d, t in texts:
        xs = (t or "").split("\n")
        stay = [x for x in xs if d is None or len(key(x)) < least or owner[key(x)] == d]
        out.append((d, len(xs), len(xs) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def test_against_brute_force(make_docs):
    r = random.Random(1)
    lines = [f"common line number {k}" for k in range(12)] + ["Éa straße ÉÀ line", "éa straße éà line", "short", "", "  COMMON line NUMBER 3\t", "x" * 3000]
    texts = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 9)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "\n\n"), (103, "common line number 0\n" * 500), (None, "common line number 1"), (5, texts[5][1]), (7, "common line number 2\nown line of seven")]
    assert got(dedup_lines(make_docs(texts))) == brute(texts)
    assert got(dedup_lines(make_docs(texts), n_batches=1)) == brute(texts)
    assert got(dedup_lines(make_docs(texts), n_batches=7, fanout=3)) == brute(texts)


def test_empty_and_columns(make_docs):
    docs = make_docs([])
    out = dedup_lines(docs)
    assert out.count() == 0 and out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    one = dedup_lines(make_docs([(4, "a line of the text\nA LINE of the text")])).first()
    assert (one.n_dropped, one.component_id, one.ld_id) == (0, "x", "y")
    assert hashlib.sha256(one.kept_text.encode()).hexdigest() == hashlib.sha256(b"a line of the text\nA LINE of the text").hexdigest()


def test_runs_are_levelled_and_sorted(spark):
    runs = LineRuns(spark, fanout=2)
    try:
        for k in range(4):
            rows = spark.range(k * 50, k * 50 + 100).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.lit(k).cast("long").alias("owner"))
            owners = rows.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
            runs.add(runs.unseen(owners))
            runs.compact()
        assert [len(x) for x in runs.levels] == [0, 0, 1]
        all_rows = runs.tables()[0].collect()
        assert len(all_rows) == len({(r.h1, r.h2) for r in all_rows}) == 250
        assert {r.owner for r in all_rows if r.h2 < 100} == {0}
        plan = runs.unseen(owners)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and len(re.findall("Exchange hashpartitioning", plan)) == 1
    finally:
        runs.close()
