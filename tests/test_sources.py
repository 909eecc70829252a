"""Files on disk: images, shards, masks, run artifacts, sinks, growing logs."""

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumatable.operators import catalog, pixels, runs
from lumatable.sources import growing_csv, images, presets, run_files, sinks
from lumatable.sources.run_files import LOG_COLUMNS
from lumatable.streaming import monitor


def png(path, array):
    """Write an 8-bit grey or RGB PNG."""
    array = np.asarray(array, dtype=np.uint8)
    kind = 2 if array.ndim == 3 else 0

    def chunk(tag, data):
        body = tag + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    h, w = array.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in array)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
    data += chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    write(path, data)


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return str(tmp_path_factory.mktemp("files"))


def test_pairs_follow_the_high_folder(spark, root):
    for name in ("a.png", "B.PNG", "c.jpeg", "only_high.png", "d.tiff", "e.txt"):
        write(f"{root}/set/our485/high/{name}", "x")
    for name in ("a.png", "B.PNG", "c.jpeg", "d.tiff", "only_low.png"):
        write(f"{root}/set/our485/low/{name}", "x")
    write(f"{root}/set/our485/high/sub/f.png", "x")
    write(f"{root}/set/our485/low/sub/f.png", "x")
    pairs = images.paired_files(spark, f"{root}/set", "our485").orderBy("name").collect()
    assert [p["name"] for p in pairs] == ["B.PNG", "a.png", "c.jpeg"]
    assert pairs[1]["low_path"].endswith("/low/a.png")
    listed = images.list_files(spark, f"{root}/set/our485/high")
    assert listed.count() == 5
    assert images.list_assets(spark, f"{root}/no/such/folder").count() == 0
    counts = catalog.count_by_dir(listed, "path", ("png",)).select("n_images").collect()
    assert sorted(r[0] for r in counts) == [1, 3]


def test_masks_by_path_then_by_id(spark, root):
    for name in ("x/one.jpg", "x/two.jpg", "three.webp"):
        write(f"{root}/masked/images/{name}", "x")
    for name in ("x/one.png", "x__two.png"):
        write(f"{root}/masked/masks/{name}", "x")
    found = catalog.match_masks(*images.masked_files(spark, f"{root}/masked"), "image", "mask")
    assert {r["sample_id"]: r["mask"] for r in found.collect()} == {
        "x__one": "x/one.png", "x__two": "x__two.png", "three": None,
    }
    with pytest.raises(Exception, match="Mask not found for sample three"):
        catalog.require_masks(found, "mask").collect()


def test_decoded_pixels(spark, root):
    rng = np.random.default_rng(1)
    colour, gray = rng.integers(0, 256, (16, 20, 3)), rng.integers(0, 256, (8, 8))
    png(f"{root}/img/colour.png", colour)
    png(f"{root}/img/gray.png", gray)
    write(f"{root}/img/broken.png", "not an image")
    read = images.read_images(spark, f"{root}/img")
    assert {os.path.basename(r["path"]): r["ok"] for r in read.select("path", "ok").collect()}["colour.png"] == 1
    arrays = images.rgb_arrays(read, F.regexp_extract("path", r"([^/]+)\.png$", 1))
    rows = {r["image_id"]: np.array(r["data"]).reshape(r["h"], r["w"], 3) for r in arrays.collect()}
    assert set(rows) == {"colour", "gray"}
    assert (rows["colour"] == colour).all() and (rows["gray"] == gray[..., None]).all()
    assert pixels.rgb_pixels(pixels.by_image(arrays)).count() == 16 * 20 + 64
    labels = images.label_pixels(read, F.col("path")).where(F.col("h") == 8)
    assert [r["label_id"] for r in labels.orderBy("y", "x").collect()] == gray.ravel().tolist()


def test_label_checks(spark):
    df = spark.createDataFrame([(1, 0), (1, 255), (1, 40), (2, 18), (2, 19), (2, 33)], "image_id int, label_id int")
    bad = catalog.invalid_labels(df, catalog.TRAIN_IDS, "image_id").collect()
    assert {r["image_id"]: (r["n_invalid"], r["invalid"]) for r in bad} == {1: (1, "40"), 2: (2, "19,33")}
    with pytest.raises(Exception, match="Unsupported label"):
        catalog.require_labels(df, catalog.LABEL_IDS).collect()
    groups = catalog.class_groups(spark)
    for space in (catalog.LABEL_IDS, catalog.TRAIN_IDS):
        assert catalog.group_overlap(groups.where(F.col("label_space") == space), space).count() == 0


def test_shards_and_tree(spark, root):
    def shard(name, n):
        os.makedirs(f"{root}/shards/data", exist_ok=True)
        cell = [{"bytes": bytes([i])} for i in range(n)]
        pq.write_table(pa.table({"image": cell, "semantic_segmentation": cell}), f"{root}/shards/data/{name}.parquet")

    shard("val-00001", 2)
    shard("val-00000", 3)
    shard("train-00000", 1)
    rows = images.read_shards(spark, f"{root}/shards", "val")
    found = catalog.shard_ids(rows, "split", "shard", "row").orderBy("sample_id").collect()
    assert [r["sample_id"] for r in found][2:4] == ["val__shard00__row00002", "val__shard01__row00000"]
    assert [bytes(r["image"])[0] for r in found] == [0, 1, 2, 0, 1]
    for city in ("aachen", "bonn"):
        write(f"{root}/tree/leftImg8bit/val/{city}/{city}_1_leftImg8bit.png", "x")
        write(f"{root}/tree/gtFine/val/{city}/{city}_1_gtFine_labelIds.png", "x")
        write(f"{root}/tree/gtFine/val/{city}/{city}_1_gtFine_color.png", "x")
    tree = images.read_tree(spark, f"{root}/tree", "val").orderBy("sample_id").collect()
    assert [r["sample_id"] for r in tree] == ["aachen__aachen_1_leftImg8bit", "bonn__bonn_1_leftImg8bit"]
    assert tree[0]["mask_source_path"].endswith("aachen_1_gtFine_labelIds.png")


def log_text(rows):
    lines = [",".join(LOG_COLUMNS)]
    lines += [",".join(str(row.get(c, "")) for c in LOG_COLUMNS) for row in rows]
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def run_root(root):
    steps = [{"step": i, "phase": "stage3_joint", "samples_per_sec": i, "cpu_percent": "None"} for i in range(1, 31)]
    steps.append({"step": 30, "phase": "validation", "val_psnr": 21.5})
    steps += [{"step": i, "phase": "stage3_joint", "samples_per_sec": i, "gpu_reserved_gb": 2.0} for i in (28, 29)]
    write(f"{root}/runs/one/training_metrics.csv", log_text(steps))
    warm = [{"step": i, "phase": "decom_warmup" if i < 4 else "x", "samples_per_sec": i} for i in range(8)]
    write(f"{root}/runs/two/training_metrics.csv", log_text(warm))
    write(f"{root}/runs/empty/training_metrics.csv", log_text([]))
    report = "[steps=20]\nPSNR: 20.5\n\n[steps=8]\nPSNR: 18.0\nSSIM: oops\n\n[steps=8]\nSSIM: 0.5\nSecondsPerImage: 0.25\n\nStep: None\n"
    write(f"{root}/runs/one/metrics.txt", report)
    write(f"{root}/runs/two/metrics.txt", "[steps=4]\nPSNR: 1.0\n")
    write(f"{root}/runs/two/full_eval/metrics.txt", "[steps=20]\nPSNR: 30.0\nLPIPS: 0.125\nStep: 70\n")
    write(f"{root}/runs/three/training_status.json", json.dumps({"val_psnr": 19.0, "step": "12.0", "val_ssim": None}, indent=1))
    summary = {"config_name": "small", "effective_batch_size": 16, "resolution": 256}
    write(f"{root}/runs/one/resolved_config.json", json.dumps({"args": {"lr": 1}, "summary": summary}, indent=2))
    for step in (5, 40, 300):
        write(f"{root}/runs/one/checkpoint-{step}/checkpoint_metadata.json", json.dumps({"best_psnr": step / 2}))
    write(f"{root}/runs/one/checkpoint-old/checkpoint_metadata.json", json.dumps({"best_psnr": "bad"}))
    write(f"{root}/runs/one/best_model/best_metadata.json", json.dumps({"args": {"v": "best"}}))
    write(f"{root}/runs/one/best_model/metadata.json", json.dumps({"args": {"v": "final"}}))
    return f"{root}/runs"


def test_summaries_of_all_runs(spark, run_root):
    table = {r["name"]: r for r in run_files.summarize_runs(spark, run_root).collect()}
    one, two, three = table["one"], table["two"], table["three"]
    tail = list(range(14, 31)) + [28, 29]
    assert one["sampled_phase"] is None and one["sampled_rows"] == 20 and one["latest_step"] == 29
    assert one["throughput_mean"] == pytest.approx(sum(tail) / len(tail)) and one["cpu_percent_mean"] is None
    assert one["gpu_reserved_max"] == 2.0 and one["primary_step"] == 8
    assert one["psnr"] is None and one["ssim"] == 0.5 and one["seconds_per_image"] == 0.25
    assert two["sampled_phase"] == "decom_warmup" and two["sampled_rows"] == 4 and two["throughput_mean"] == 1.5
    assert two["primary_step"] == 20 and two["psnr"] == 30.0 and two["lpips"] == 0.125
    assert two["metrics_source"].endswith("full_eval/metrics.txt")
    assert three["psnr"] == 19.0 and three["primary_step"] == 8 and three["sampled_rows"] == 0
    lines = {r["run"].rsplit("/", 1)[1]: r["lines"] for r in run_files.summary_lines(run_files.summarize_runs(spark, run_root)).collect()}
    assert "config_summary: config=small effective_batch=16 resolution=256 decom=None condition=None" in lines["one"]
    assert "psnr: -" in lines["one"] and "psnr: 30.0000" in lines["two"] and "config_summary" not in lines["two"]


def test_log_positions_follow_the_file(spark, run_root):
    rows = run_files.read_logs(spark, run_root).where(F.col("run").endswith("/one")).orderBy("pos").collect()
    assert [r["step"] for r in rows] == [*range(1, 31), 30, 28, 29]
    assert rows[30]["val_psnr"] == 21.5 and rows[0]["cpu_percent"] is None


def test_reports_and_cards(spark, run_root):
    files = run_files.read_reports(spark, run_root)
    lines = runs.report_lines(files, "path", "text")
    steps = {r["path"].split("/runs/")[1]: r["train_step"] for r in runs.report_step(lines, "path").collect()}
    assert steps == {"one/metrics.txt": None, "two/full_eval/metrics.txt": 70}
    cards = runs.parse_report_cards(lines, "path").where(F.col("path").contains("/one/")).collect()
    assert {r["card"]: r["value"] for r in cards} == {"PSNR": 18.0, "SSIM": 0.5}


def test_checkpoints_and_metadata(spark, run_root):
    found = run_files.read_checkpoint_metadata(spark, run_root)
    assert sorted((r["step"], r["best_psnr"]) for r in found.collect()) == [(5, 2.5), (40, 20.0), (300, 150.0)]
    assert runs.latest_checkpoint(found, "run", "path").first()["path"].endswith("checkpoint-300")
    assert [r["step"] for r in runs.stale_checkpoints(found, "run", 2).collect()] == [5]
    model = run_files.read_model_metadata(spark, f"{run_root}/one/best_model").first()
    assert model["args"] == {"v": "final"}


def test_presets(spark, root):
    write(f"{root}/presets/small.json", json.dumps({"meta": {"name": "small", "target_vram_gb": 6}, "optimization": {"batch_size": 4, "gradient_accumulation_steps": 4}}))
    write(f"{root}/presets/bare.json", json.dumps({"runtime": {"resolution": 512}}))
    table = {r["name"]: r for r in presets.preset_summary(presets.read_presets(spark, f"{root}/presets")).collect()}
    assert table["small"]["effective_batch"] == 16 and table["small"]["resolution"] == "-"
    assert table["bare"]["effective_batch"] == 1 and table["bare"]["resolution"] == "512"


def test_sinks_skip_what_is_there(spark, root):
    path = f"{root}/out/samples"
    first = spark.createDataFrame([("train", "a", 1), ("val", "b", 1)], "split string, sample_id string, v int")
    more = spark.createDataFrame([("train", "a", 2), ("train", "c", 2)], "split string, sample_id string, v int")
    assert sinks.export_samples(first, path, ["split", "sample_id"], "split").count() == 2
    sinks.export_samples(more, path, ["split", "sample_id"], "split")
    rows = sorted((r["split"], r["sample_id"], r["v"]) for r in spark.read.parquet(path).collect())
    assert rows == [("train", "a", 1), ("train", "c", 2), ("val", "b", 1)]
    sinks.export_samples(more, path, ["split", "sample_id"], "split", overwrite=True)
    rows = sorted((r["split"], r["sample_id"], r["v"]) for r in spark.read.parquet(path).collect())
    assert rows == [("train", "a", 2), ("train", "c", 2), ("val", "b", 1)]
    triplet = spark.createDataFrame([("a", b"h", b"s", b"l")], "sample_id string, h binary, s binary, l binary")
    for _ in range(2):
        sinks.write_triplet(triplet, f"{root}/out/triplet", "sample_id", {"high": "h", "semantic": "s", "low": "l"})
    assert spark.read.parquet(f"{root}/out/triplet").count() == 3
    status = spark.createDataFrame([("one", 3, 1.5)], "run string, step int, loss double")
    sinks.write_status(status, f"{root}/out/status")
    assert spark.read.json(f"{root}/out/status").first()["step"] == 3
    sinks.append_metrics(status, f"{root}/out/metrics")
    sinks.append_metrics(status, f"{root}/out/metrics")
    assert spark.read.option("header", True).csv(f"{root}/out/metrics").count() == 2
    reports = spark.createDataFrame([("one", "[steps=8]\nPSNR: 1\n")], "run string, report string")
    sinks.write_reports(reports, f"{root}/out/reports")
    assert spark.read.text(f"{root}/out/reports").count() >= 2


def test_overwrite_replaces_only_the_given_samples(spark, root):
    schema, kinds = "sample_id string, h binary, s binary, l binary", {"high": "h", "semantic": "s", "low": "l"}
    for buckets in (0, 3):
        path = f"{root}/out/replace{buckets}"
        both = spark.createDataFrame([("a", b"h", b"s", b"l"), ("b", b"h", b"s", b"l")], schema)
        sinks.write_triplet(both, path, "sample_id", kinds, overwrite=True, buckets=buckets)  # no table yet
        sinks.write_triplet(spark.createDataFrame([("b", b"H", b"S", b"L")], schema), path, "sample_id", kinds, overwrite=True, buckets=buckets)
        rows = {(r["sample_id"], r["kind"]): bytes(r["data"]) for r in spark.read.parquet(path).collect()}
        assert rows == {(i, k): (c.encode().upper() if i == "b" else c.encode()) for i in "ab" for k, c in kinds.items()}


def test_overwrite_with_null_and_whole_number_partitions(spark, root):
    path, schema = f"{root}/out/numbered", "split int, sample_id string, v int"
    first = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (None, "a", 1), (None, None, 1)], schema)
    sinks.export_samples(first, path, ["split", "sample_id"], "split")
    more = spark.createDataFrame([(2, "a", 5), (None, None, 5), (3, "n", 5)], schema).withColumn("extra", F.lit("x"))
    counts = sinks.export_samples(more, path, ["split", "sample_id"], "split", overwrite=True)
    assert sorted((r["split"] or 0, r["n_samples"]) for r in counts.collect()) == [(0, 1), (2, 1), (3, 1)]
    rows = spark.read.option("mergeSchema", True).parquet(path).collect()
    got = sorted(((r["split"] or 0), r["sample_id"] or "", r["v"], r["extra"] or "") for r in rows)
    assert got == [(0, "", 5, "x"), (0, "a", 1, ""), (1, "a", 1, ""), (2, "a", 5, "x"), (3, "n", 5, "x")]


def test_a_failed_overwrite_leaves_the_table(spark, root):
    path, schema = f"{root}/out/failing", "split string, sample_id int, v int"
    sinks.export_samples(spark.createDataFrame([("train", i, 1) for i in range(50)], schema), path, ["split", "sample_id"], "split")
    broken = spark.createDataFrame([("train", i, 2) for i in range(40)], schema).withColumn(
        "v", F.when(F.col("sample_id") == 39, F.raise_error(F.lit("no such image"))).otherwise(F.col("v")).cast("int")
    )
    with pytest.raises(Exception, match="no such image"):
        sinks.export_samples(broken, path, ["split", "sample_id"], "split", overwrite=True)
    assert spark.read.parquet(path).where("v = 1").count() == 50
    assert spark.read.parquet(path).count() == 50


def test_growing_log(spark, root):
    path = f"{root}/live/one/training_metrics.csv"
    full = log_text([{"step": i, "phase": "p", "loss": i / 2} for i in range(200)])
    cut = full.index("\n150,") + 3
    write(path, full[:cut])
    assert growing_csv.complete_size(path) < cut
    size = growing_csv.complete_size(path)
    whole = [line for _, _, line in growing_csv.lines_between(path, 0, size, True)]
    pieces = [line for low in range(0, size, 97) for _, _, line in growing_csv.lines_between(path, low, min(low + 97, size), low == 0)]
    assert pieces == whole and len(whole) == 151

    def run():
        out = monitor.stream_logs(spark, f"{root}/live/*/training_metrics.csv").select("run", "pos", "step", "loss")
        query = (
            out.writeStream.format("parquet").option("path", f"{root}/live-out").option("checkpointLocation", f"{root}/live-state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.read.parquet(f"{root}/live-out").orderBy("pos")

    assert [r["step"] for r in run().collect()] == list(range(150))
    with open(path, "ab") as handle:
        handle.write(full[cut:].encode())
    rows = run().collect()
    assert [r["step"] for r in rows] == list(range(200)) and rows[199]["loss"] == 99.5


def test_yaml_presets(spark, root):
    pytest.importorskip("yaml")
    write(f"{root}/yaml/middle.yaml", "meta:\n  name: middle\noptimization:\n  batch_size: 2\n  gradient_accumulation_steps: 4\nschedule:\n  max_train_steps:\n")
    row = presets.preset_summary(presets.read_presets(spark, f"{root}/yaml", "yaml")).first()
    assert row["name"] == "middle" and row["effective_batch"] == 8


def test_split_folders_by_preference(spark, root):
    for name in ("val/low", "val/high", "eval15/low", "train/low", "train/high"):
        write(f"{root}/layout/{name}/a.png", "x")
    assert images.resolve_split(spark, f"{root}/layout", ("eval15", "val")).endswith("/val")  # eval15 has no high folder
    assert images.resolve_split(spark, f"{root}/layout", ("our485", "train")).endswith("/train")
    with pytest.raises(FileNotFoundError, match="our485/{low,high}, .*/none/{low,high}"):
        images.resolve_split(spark, f"{root}/layout", ("our485", "none"))
