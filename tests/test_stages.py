"""Stages: conditions, stand-ins, failure rows; a file that fails degrades alone."""

from pyspark.sql import functions as F

from sparkloom.plans import stages as st

FILES = [("a", "1 2"), ("b", "x"), ("c", None), ("d", "4"), ("e", "7 too many")]


def parser():
    """A function of its own: workers can't import this module."""

    def numbers(path, text):
        for k, word in enumerate(text.split()):
            yield k, int(word)

    return numbers


def frame(spark):
    return spark.createDataFrame(FILES, "file_path string, text string")


def test_a_failing_file_degrades_alone(spark):
    rows, failures = st.guarded(frame(spark), "parse", parser(), "k int, n long")
    assert sorted(map(tuple, rows.collect())) == [("a", 0, 1), ("a", 1, 2), ("d", 0, 4)]
    assert {(r.stage, r.file_path, r.error) for r in failures.collect()} == {("parse", "b", "ValueError"), ("parse", "e", "ValueError")}
    got = st.degraded(frame(spark), failures).collect()
    assert {r.file_path for r in got} == {"b", "e"} and all(r.node_type == "PROGRAM" and "invalid literal" in r.attributes for r in got)
    none, fine = st.guarded(frame(spark).limit(0), "parse", parser(), "k int, n long")
    assert none.collect() == fine.collect() == []


def test_rows_that_do_not_fit_are_the_files_failure(spark):
    rows, failures = st.guarded(frame(spark), "parse", lambda path, text: [("no number",)] if path == "a" else [(1,)], "n long")
    assert sorted(r.file_path for r in rows.collect()) == ["b", "c", "d", "e"]
    assert [r.file_path for r in failures.collect()] == ["a"]


def test_routes(spark):
    def lost(state):
        return {"nodes": state["files"].select(F.raise_error(F.lit("lost")).alias("x"))}

    stages = [
        st.Stage("first", lambda s: {"count": s["files"].groupBy().count()}),
        st.Stage("never", lost, when=lambda s: s["count"].first()[0] > 99),
        st.Stage("parse", lost, instead=st.Stage("fallback", lambda s: {"nodes": s["files"].select("file_path")})),
        st.Stage("last", lambda s: {"out": s["nodes"].limit(2)}),
    ]
    got = st.run_stages(spark, stages, {"files": frame(spark)})
    assert [(r.ord, r.stage, r.status, r.rows) for r in got.stage_results(spark).orderBy("ord").collect()] == [(0, "first", "ok", 1), (1, "never", "skipped", 0), (2, "parse", "failed", 0), (3, "fallback", "ok", 5), (4, "last", "ok", 2)]
    assert not got.failed and got.state["out"].count() == 2 and got.results[2][4]
    got = st.run_stages(spark, [stages[0], st.Stage("parse", lost), stages[3]], {"files": frame(spark)})
    assert got.failed and [r[1:3] for r in got.results] == [("first", "ok"), ("parse", "failed"), ("last", "skipped")]
    assert "count" in got.state and "out" not in got.state
