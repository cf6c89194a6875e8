"""What a stage's executors hold goes back before the next stage's workers come."""


def _collections(spark) -> int:
    """Full collections of this JVM so far, which is the executors' too where all run on this machine."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_packing_begins_with_a_heap_given_back(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    before = _collections(spark)
    assert corpus_pipeline.pack_windows(spark, docs, "").count() >= 2
    assert _collections(spark) > before


def test_every_core_collects(spark):
    from quadrille.llm.common import slim

    before = _collections(spark)
    slim(spark)
    assert _collections(spark) - before >= spark.sparkContext.defaultParallelism


def test_the_driver_keeps_little_free_heap(spark, monkeypatch):
    """check_h took the driver beyond 1500 MB: its heap had grown to its limit over five stages' plans."""
    from quadrille.llm import common

    monkeypatch.setattr(common, "LEAN", 0)
    before = _collections(spark)
    common.materialize(spark.range(3), "lean")
    assert _collections(spark) > before
    kind = spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
    flags = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
    assert int(flags.getVMOption("MaxHeapFreeRatio").getValue()) <= 25
