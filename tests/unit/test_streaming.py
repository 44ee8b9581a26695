from packetloom.functions.keys import with_key
from packetloom.operators import routing as ro
from packetloom.streaming import live

from .test_operators import cohort_of, frame, packet


def test_streams_keep_what_batches_keep(spark, tmp_path):
    first = frame(spark, [packet(1, 10, 2, 80, 1, 1000), packet(2, 20, 1, 1000, 2, 80, flags=2), packet(3, 30, 9, 1, 8, 2, flags=4)])
    second = frame(spark, [packet(4, 1000, 1, 5, 7, 53, protocol=17), packet(5, 5000, 1, 1000, 2, 80, flags=1)])
    landing = str(tmp_path / "in")
    first.write.parquet(landing)
    second.write.mode("append").parquet(landing)
    cohort = cohort_of(spark, [[1, 6, 1, 1000, 2, 80, 0, 0, "h1"]]).cache()
    stream = live.packet_stream(spark, landing, first.schema)
    for q in live.keep_observations(stream, cohort, str(tmp_path / "out"), str(tmp_path / "check")):
        assert q.awaitTermination(120)
    both = with_key(first.unionByName(second))
    got = {t: sorted(r.packet_index for r in spark.read.parquet(str(tmp_path / "out" / t)).collect()) for t in ("target_packets", "source_context_packets")}
    assert got["target_packets"] == sorted(r.packet_index for r in ro.route_to_targets(both, cohort).collect()) == [1, 2, 5]
    assert got["source_context_packets"] == sorted(r.packet_index for r in ro.retain_source_context(both, cohort).collect()) == [2, 4, 5]


def test_quarter_hours(spark, tmp_path):
    rows = frame(spark, [packet(1, 10, 2, 80, 1, 1000), packet(2, 899, 1, 1000, 2, 80), packet(3, 901, 1, 53, 2, 53, protocol=17), packet(4, 9000, 1, 1, 2, 2)])
    landing = str(tmp_path / "in")
    rows.write.parquet(landing)
    counts = live.quarter_hours(live.packet_stream(spark, landing, rows.schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("quarter_hours").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(tuple(r)[:3] for r in spark.table("quarter_hours").collect())
    assert got == [("197001010000", 6, 2), ("197001010015", 17, 1), ("197001010230", 6, 1)]
