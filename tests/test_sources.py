"""Reading the subject tables and writing results."""

from faultline import read_catalog, read_parquet
from faultline.plans import registry, reports
from faultline.sources.sinks import register_views, write_frames
from faultline.sources.tables import SCHEMAS
from conftest import SMALL


def test_subject_tables_from_parquet(spark, tables, tmp_path):
    for name in SCHEMAS:
        getattr(tables, name).write.parquet(str(tmp_path / name))
    stored = read_parquet(spark, str(tmp_path))
    assert stored.recalls.schema.simpleString() == spark.createDataFrame([], SCHEMAS["recalls"]).schema.simpleString()
    for report in (reports.q01, reports.q03, reports.q06, reports.q09, reports.q14):
        assert list(map(tuple, report(stored).collect())) == list(map(tuple, report(tables).collect()))
    # Without the test tables' own ids, reports fall back to the remaining columns.
    assert reports.q02(stored).count() == reports.q02(tables).count()
    assert reports.q08(stored).count() == reports.q08(tables).count()


def test_subject_tables_from_the_catalog(spark, tables):
    for name in SCHEMAS:
        getattr(tables, name).createOrReplaceTempView(f"their_{name}")
    named = read_catalog(spark, "default", {"ratings": "missing"})
    assert named._loaders.keys() == SCHEMAS.keys()
    spark.sql("create schema if not exists lifecycle")
    try:
        tables.ratings.write.mode("overwrite").saveAsTable("lifecycle.stars")
        named = read_catalog(spark, "lifecycle", {"ratings": "stars"})
        assert reports.q01(named).collect() == reports.q01(tables).collect()
    finally:
        spark.sql("drop schema lifecycle cascade")


def test_named_results(spark):
    register_views(spark, SMALL, registry.queries(), ["q03", "q14"])
    both = spark.sql("select count(*) from q14 join q03 on q03.MAKE = q14.VEHICLE_MAKE").first()[0]
    assert both > 0


def test_chart_frames_are_written(spark, tmp_path):
    names = ["plot_q01", "plot_q02c", "plot_q16"]
    frames = {n: registry.queries()[n](spark, SMALL) for n in names}
    paths = write_frames(frames, str(tmp_path))
    for name, path in paths.items():
        assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, frames[name].collect()))


def test_named_results_run_nothing_until_they_are_used(spark):
    from faultline.plans.registry import queries
    from faultline.sources.sinks import NamedResults

    spark.sparkContext.setJobGroup("named", "jobs of named results")

    def jobs():
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("named"))

    built = []

    def watched(name, query):
        return lambda s, root: built.append(name) or query(s, root)

    try:
        named = NamedResults(spark, SMALL, {name: watched(name, q) for name, q in queries().items()})
        assert set(named) == set(queries()) and jobs() == 0 and built == []
        assert named.sql("select count(*) as n from Q01 where AVG_OVERALL_STARS > 0").first().n > 0
        assert built == ["q01"] and jobs() > 0
        assert named["q01"] is named["q01"] and built == ["q01"]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
