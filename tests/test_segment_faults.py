import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barloom.operators import segment_faults as sf
from barloom.plans.analysis import analyze
from barloom.plans.oracles import ORACLES

from test_streaming import SCHEMA, rows_of, walk

SF = "/root/testdata/sf0.001"
K = ["symbol", "interval"]


@pytest.fixture(scope="module")
def chain(spark):
    rows = [r for k, s in enumerate("ABCD") for r in rows_of(s, walk(40 + k, 2500))]
    a = analyze(spark.createDataFrame(rows, SCHEMA).drop("arrival"), least=4, trusted=True)
    yield a
    a.release()


def codes(df):
    return {r.code for r in df.collect()}


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = __spark_entry__.queries()["segment_faults"](spark, SF).select("symbol", "interval", "pos", "code")
    want = sorted(con.execute(f"SELECT symbol, interval, pos, code FROM ({ORACLES['segment_faults']})").fetchall())
    assert sorted(map(tuple, df.collect())) == want and len(want) > 20


def test_sound_chains_have_no_fault(chain):
    gaps = chain.evidence.where("confirmation = 'GAP_REVERSE_FRACTAL'").count()
    assert chain.segments.count() > 100 and gaps > 10 and chain.waiting_candidates.count() >= gaps
    assert chain.segment_faults.count() == 0


def test_each_fault_is_found_where_it_is(chain):
    seg, st, ev, cand, exp = chain.segments, chain.strokes, chain.evidence, chain.waiting_candidates, chain.detected_segments
    at = lambda *p: F.col("pos").isin(*p)
    here = lambda df, c, value, *p: df.withColumn(c, F.when(at(*p), value).otherwise(F.col(c)))
    hour = F.expr("INTERVAL '9000' MINUTE")
    cases = [
        ("EVIDENCE_OF_ANOTHER", sf.segment_faults(seg, st, here(ev, "fingerprint", F.lit("x"), 3), cand, exp), 3),
        ("COMMIT_MISSING", sf.segment_faults(seg, st, here(ev, "committed_at", F.lit(None), 3)), 3),
        ("COMMIT_TIME_NOT_MONOTONIC", sf.segment_faults(seg, st, here(ev, "committed_at", F.col("committed_at") - hour, 5)), 5),
        ("COMMITTED_BEFORE_EVIDENCE", sf.segment_faults(seg, st, here(ev, "available_at", F.col("committed_at") + hour, 5)), 5),
        ("EVIDENCE_ENDPOINTS", sf.segment_faults(seg, st, here(ev, "start_pos", F.col("start_pos") + 1, 5)), 5),
        ("NO_ACTUAL_BREAK", sf.segment_faults(seg, st, here(ev, "broken", F.lit(False), 5)), 5),
        ("ENDPOINT_NOT_IN_CHAIN", sf.segment_faults(here(seg, "end_value", F.col("end_value") + 0.5, 5), st, ev), 5),
        ("DIRECTION_MARK", sf.segment_faults(here(seg, "direction", F.when(F.col("direction") == "up", "down").otherwise("up"), 5), st, ev), 5),
        ("STROKE_COUNT", sf.segment_faults(here(seg, "size", F.col("size") + 1, 5), st, ev), 5),
        ("CHAIN_MISMATCH", sf.segment_faults(seg, st, ev, cand, exp.where("pos <> 5")), -1),
        ("EVIDENCE_COUNT", sf.segment_faults(seg, st, ev.where("pos <> 5")), -1),
        ("OUTSIDE_STABLE_PREFIX", sf.segment_faults(seg, st, ev, stable=seg.where("pos = 5").select(*K, (F.col("end_pos") + 1).alias("stable"))), 6),
    ]
    for code, df, p in cases:
        assert (code, p) in {(r.code, r.pos) for r in df.collect()}, code


def test_skipped_primaries(chain):
    """A gap wait with a broken fractal without a gap at the segment's own end, known in time, should have ended there;
    one that is pending, has a gap, is known too late or lies behind a further endpoint should not."""
    w = chain.evidence.where("confirmation = 'GAP_REVERSE_FRACTAL' AND NOT moved AND confirmed_at_pos > origin_at")
    st = chain.strokes.select(*K, F.col("pos").alias("endpoint_pos"), F.col("start_value").alias("value"))
    own = lambda d, at, gap=False, status="confirmed": w.select(*K, "pos", (F.col("end_pos") + d).alias("endpoint_pos"), at.alias("detected_at_pos"), F.lit(gap).alias("gap"), F.lit(status).alias("status")).join(st, [*K, "endpoint_pos"])
    found = lambda c: sf.skipped_primaries(chain.evidence, chain.segments, chain.strokes, c).count()
    n = w.count()
    assert n > 3 and found(own(0, F.col("confirmed_at_pos"))) == n
    assert found(own(0, F.col("confirmed_at_pos"), gap=True)) == found(own(0, F.col("confirmed_at_pos"), status="pending")) == 0
    assert found(own(0, F.col("confirmed_at_pos") + 1)) == found(own(0, F.col("origin_at"))) == 0
    assert found(own(1, F.col("confirmed_at_pos"))) == 0  # an even number of strokes
    assert found(own(-2, F.col("confirmed_at_pos"))) == 0  # the end itself goes further
