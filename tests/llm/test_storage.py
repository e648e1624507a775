import time

from motifspark.llm import storage


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = {every.apply(i).getName() for i in range(every.size())}
        return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    before = files()
    out = storage.materialize(spark.range(1000).repartition(3, "id"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
