"""What stages leave in the driver's memory."""

import weakref

from tidewatch.llm import common, jaccard_join


def test_saved_tables_have_the_driver_collect_its_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    for _ in range(3):
        common.saved(spark.range(10), "few")
    assert whole() >= before + 3


def test_components_have_the_driver_collect_its_garbage(spark, monkeypatch):
    swept = []
    monkeypatch.setattr(common, "swept", swept.append)
    common.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b")
    assert swept


def test_clusters_give_up_the_repeat_filter_once_it_is_used(spark, monkeypatch):
    filters, found = [], []
    counts, components = common.slot_counts, common.components

    def counted(*a):
        out = counts(*a)
        filters.append(weakref.ref(out[0]))
        return out

    def joined(*a):
        found.append(filters[0]() is None)
        return components(*a)

    monkeypatch.setattr(common, "slot_counts", counted)
    monkeypatch.setattr(common, "components", joined)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string")
    rows = {r.doc_id: r.component_id for r in jaccard_join.cluster(docs).collect()}
    assert rows == {1: 1, 2: 1, 3: 3}
    assert found == [True]
