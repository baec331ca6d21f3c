import os
import shutil

from pyspark.sql import functions as F

from twinlens.operators import reports
from twinlens.streaming import items


def test_keys_and_shared_images(spark):
    lines = [
        (1, 2, {"ad1_10_kp_no": 5.0, "ad1_11_kp_no": 7.0, "ad2_20_kp_no": 4.0, "ad2_21_kp_no": 9.0, "keypoints_1_2_10_20": 3.0, "keypoints_2_1_20_10": 2.0, "keypoints_1_2_11_21": 8.0, "hist_10_20_HAMMING": 0.5, "hist_11_20_HAMMING": 0.7, "other": 1.0}),
        (1, 3, {"ad1_10_kp_no": 5.0, "ad2_30_kp_no": 1.0}),
        (1, 4, {}),
    ]
    df = spark.createDataFrame(lines, "id_1 long, id_2 long, values map<string,double>")
    signs = spark.createDataFrame([("10", "a"), ("11", "same"), ("20", "b"), ("21", "same"), ("30", "a")], "image string, signature string")
    kinds = {r.kind for r in reports.parsed_keys(df).collect()}
    assert kinds == {"ad1", "ad2", "kp_matched", "hist_hamming"}
    got = {r.id_2: r for r in reports.pair_metrics(df, signs).collect()}
    assert len(got) == 3 and len(got[2]) == 2 + 72
    # images 11 and 21 have one signature
    assert (got[2].kp_diff_min, got[2].kp_diff_max, got[2].kp_matched_mean, got[2].hist_hamming_max) == (1.0, 1.0, 2.5, 0.5)
    assert got[2].hist_correlation_min is None
    assert all(x is None for x in got[3][2:]) and all(x is None for x in got[4][2:])


def test_a_broken_run_gives_each_row_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.range(30).select((F.col("id") % 20).alias("id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 20).alias("ts"))
    rows.repartition(3).write.parquet(source)
    run = lambda t: items.append_once(items.read_new(spark, source, rows.schema, 1), ["id"], out, checkpoint, t).awaitTermination()
    run("ts")
    ids = lambda: sorted(r.id for r in items.appended(spark, out, rows.schema).collect())
    assert ids() == list(range(20))
    # as if the last batch had been written in part and not been noted as done
    done = sorted((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    os.remove(f"{checkpoint}/commits/{done[-1]}")
    crc = f"{checkpoint}/commits/.{done[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    shutil.rmtree(f"{out}/batch={done[-1]}")
    rows.where("false").write.parquet(f"{out}/batch={done[-1]}")
    run("ts")
    assert ids() == list(range(20))
    rows.where("id < 5").write.mode("append").parquet(source)
    run("ts")
    assert ids() == list(range(20))


def test_descriptions_of_grey_and_broken_images(spark):
    from twinlens.operators import metadata

    line = '{"Type": "Bilevel", "Channel moments": {"Gray": {"Centroid": "3.5,4", "I1": "0.1 (2e-3)"}}, "Channel statistics": {"Gray": {"min": "7 (0.5)", "entropy": "x"}}, "Channel perceptual hash": {"Red, Hue": {"PH1": "1.5, -2"}}, "Number pixels": "2.5K", "Filesize": "7B", "Geometry": "640x480+0+0"}'
    df = spark.createDataFrame([(1, line), (2, "{}"), (3, None), (4, "not json")], "id long, line string").select("id", F.from_json("line", metadata.schema()).alias("m"))
    got = {r.id: r for r in df.select("id", *[c.alias(n) for n, c in metadata.image_scalars(F.col("m"), ["Red, Hue"]).items()]).collect()}
    one = got[1]
    assert one.moments_overall_ellipse_centroid_x == one.moments_blue_ellipse_centroid_x == 3.5 and one.moments_red_I1_2 == 0.002
    assert (one.imstat_green_min, one.imstat_green_entropy, one.phash_red_ph1, one.phash_hue_ph1) == (0.5, None, 1.5, -2.0)
    assert (one.no_pixels, one.filesize, one.geometry, one.type) == (2500.0, 7.0, "640x480", "Bilevel")
    assert all(x is None for k in (2, 3, 4) for x in got[k][1:])
