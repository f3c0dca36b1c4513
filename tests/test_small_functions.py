"""The small functions that no query reaches."""

from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions import text as tx
from tidemark.functions import time as tm
from tidemark.operators import documents as dc
from tidemark.operators import joins as jn
from tidemark.operators import remap as rm
from tidemark.operators import sequence as sq
from tidemark.plans import master as ms
from tidemark.sources import documents as src


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_media_identity_and_discovery(spark):
    media = spark.createDataFrame([("/a/b/x.mp4", 10, "h", 5.0, 2), ("/z/x.mp4", 10, "h", 5.0, 2), ("/a/y.mp4", 11, "h", 5.0, 2)], "path string, size long, sampled_hash string, duration double, tracks int")
    prints = src.fingerprint(media)
    assert prints.select("identity").distinct().count() == 2
    catalog = prints.withColumn("digest", F.lit("d"))
    identity = prints.where("path = '/z/x.mp4'").first()["identity"]
    assert [r["path"] for r in src.discover(catalog, identity, "/a/b").collect()] == ["/a/b/x.mp4"]
    masters = spark.createDataFrame([("X.mp4", 5.2), ("x.mp4", 9.0)], "name string, duration double")
    found = src.legacy_match(masters, spark.createDataFrame([("x.mp4", 5.0, 1)], "name string, duration double, media_id int"), 0.5)
    assert [(r["name"], r["media_id"]) for r in found.collect()] == [("X.mp4", 1)]


def test_optional_and_versions(spark, tmp_path):
    assert src.optional(spark, None, src.WORD).count() == 0 and src.optional(spark, None, src.BREATH).columns == ["start", "end"]
    for revision in (1, 2):
        src.save_version(spark.createDataFrame([(1, f"v{revision}")], "id int, body string"), str(tmp_path / "doc"), revision)
    rows = spark.read.parquet(str(tmp_path / "doc"))
    assert [r["body"] for r in dc.latest(rows, ["id"], "revision").collect()] == ["v2"]
    chunks = spark.createDataFrame([(1, "c1", 0, 10), (1, "c2", 10, 20)], "media_id int, chunk_id string, t_ini long, t_fin long")
    events = spark.createDataFrame([(1, 7, 5, 15)], "media_id int, event_id int, t_ini long, t_fin long")
    src.write_chunks(chunks, events, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2


def test_words_and_masters(spark):
    words = spark.createDataFrame([(1, 0, 5, "b"), (1, 0, 3, "a")], "m int, t_ini long, t_fin long, id string")
    assert [(r["id"], r["stable_id"]) for r in ms.numbered_words(words, ["m"], "id").orderBy("stable_id").collect()] == [("a", "w000000"), ("b", "w000001")]
    assert [(r["id"], r["pos"]) for r in ms.word_map(words, ["m"], "id").orderBy("pos").collect()] == [("a", 0), ("b", 1)]
    a = spark.createDataFrame([(1, 0, 0), (1, 1, 5)], "m int, pos int, t_ini long")
    b = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.1)], "m int, pos int, signal double")
    assert [r["mismatch"] for r in ms.enrich_words(a, b, ["m"], "pos").orderBy("pos").collect()] == [True, False, True]
    ev = spark.createDataFrame([(1, i, i, i + 1, float(v)) for i, v in enumerate([0, 0, 0, 9])], "m int, event_id int, t_ini long, t_fin long, value double")
    assert [r["event_id"] for r in ms.signals(ev, ["m"], "value", 1.5, 400).collect()] == [3]


def test_rectangles_and_geometry(spark):
    rect = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 10, 10), (0, 0, 1, 1, 5, 5, 1, 1)], "a int, b int, c int, d int, e int, f int, g int, h int")
    assert [r[0] and tuple(r[0]) for r in rect.select(jn.rectangle_overlap(("a", "b", "c", "d"), ("e", "f", "g", "h"))).collect()] == [(5, 5, 5, 5), None]
    assert tuple(one(spark, sc.rect_pixels(F.lit(0.1), F.lit(0.2), F.lit(0.5), F.lit(0.5), 100, 50))[0]) == (10, 10, 50, 25)
    eye = {f"{w}_{s}": F.lit(0.5 if (w, s) in {("out", "left"), ("in", "right")} else 0.0) for w in ("in", "out", "up", "down") for s in ("left", "right")}
    assert one(spark, *sc.eye_direction(eye)) == (0.5, 0.0)
    unit = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    assert one(spark, *sc.euler(unit)) == (0.0, 0.0, 0.0)
    zone = (-5, 5, -5, 5)
    assert one(spark, sc.in_zone(F.lit(3), F.lit(3), zone), sc.camera_zone(F.lit(7), F.lit(0), F.lit(-0.2), F.lit(None).cast("double"), zone)) == (True, True)


def test_states_and_identity(spark):
    assert one(spark, sc.cut_state(F.lit(True), F.lit(True)), sc.cut_lane(F.lit(""), F.lit("ai")), sc.state_for(F.lit("reject")), sc.source_layer(F.lit("l1#2"))) == ("accepted", "ai", "rejected", "l1")
    df = spark.createDataFrame([(1, None, 1, None), (1, 2, 1, 3)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(sc.same_identity(["a", "b"], ["c", "d"])).collect()] == [True, False]
    assert [n for n in ("a", "api_key", "Token", "s_suppkey", "monkey") if not sc.is_secret(n)] == ["a", "s_suppkey", "monkey"]
    cost = one(spark, sc.online_cost(F.lit(61), 0.5, 2.0))[0]
    assert (float(cost["cost"]), cost["wait"]) == (1.0, 30.5)
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert one(spark, sc.retry_after(F.lit("7"), now), sc.retry_after(F.lit("Mon, 01 Jan 2024 00:00:09 GMT"), now)) == (7.0, 9.0)


def test_more_text_and_time(spark):
    assert one(spark, tx.clean_model_text(F.lit(" 1. a  cat (0.9) <none>")), tx.letters(F.lit("L'Été!"), "'")) == ("a cat", "l'ete")
    assert one(spark, tm.cue(F.lit(61_250)), tm.minutes(F.lit(3_661_005)), tm.clock(F.lit(61_000)), tm.frames(F.lit(1040), 25)) == ("01:01.2", "61:01.005", "1:01", "00:00:01:01")
    ranges = F.array(F.struct(F.lit(0).alias("t_ini"), F.lit(5000).alias("t_fin")))
    assert one(spark, tm.ranges_summary(ranges), tm.frame_step(F.lit(None).cast("double")), tm.to_ms(F.lit(1.5))) == ("0:00-0:05", 1 / 30, 1500)


def test_edge_sentences_and_layers(spark):
    assert one(spark, *(sq.ends_sentence(F.lit(w)) for w in ("end.", 'end."', "end", "end…»"))) == (True, True, False, True)
    mapping = spark.createDataFrame([(1, 0, 0, 10, 0, 10)], "m int, segment int, source_ini long, source_fin long, child_ini long, child_fin long")
    items = spark.createDataFrame([(1, 1, None, 0, 5), (1, 2, None, 50, 60), (1, 3, 2, 2, 4), (1, 4, 1, 1, 2)], "m int, id int, parent int, t_ini long, t_fin long")
    assert sorted(r["id"] for r in rm.derive_layer(items, mapping, ["m"], "id", "parent").collect()) == [1, 4]
    assert [r["id"] for r in dc.replace_lane(items, items.limit(0), F.col("parent").isNull()).orderBy("id").collect()] == [3, 4]


def test_file_digests_by_ranged_reads(spark, tmp_path):
    import hashlib

    from pyspark.sql.datasource import GreaterThan, LessThan

    from tidemark.sources.files import FileDigests, changed_content, file_digests

    big, block = tmp_path / "media" / "big.bin", 8 << 20
    big.parent.mkdir()
    with open(big, "wb") as f:  # a file with holes: 3 GB by its size, some bytes on disk
        f.write(b"first")
        f.seek(3 << 30)
        f.write(b"last")
    size = big.stat().st_size
    (big.parent / "small.bin").write_bytes(b"abc")
    (big.parent / "empty.bin").write_bytes(b"")
    (big.parent / "note.txt").write_bytes(b"x")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in file_digests(spark, str(tmp_path), "*.bin", whole=1 << 20).collect()}
    middle, end = b"\0" * block, b"\0" * (block - 4) + b"last"
    want = hashlib.sha256(str(size).encode() + b"first".ljust(block, b"\0") + middle + end).hexdigest()
    assert set(rows) == {"big.bin", "small.bin", "empty.bin"}
    assert (rows["big.bin"]["digest"], rows["big.bin"]["size"], rows["big.bin"]["bytes_read"]) == (want, size, 3 * block)
    assert rows["small.bin"]["digest"] == hashlib.sha256(b"3abc").hexdigest() and rows["empty.bin"]["digest"] == hashlib.sha256(b"0").hexdigest()

    few = file_digests(spark, str(tmp_path), "*.bin", whole=1 << 20).where("size < 100 and path like '%small%'")
    assert [r["size"] for r in few.collect()] == [3]
    reader = FileDigests({"path": str(tmp_path), "pattern": "*.bin"}).reader(None)
    left = list(reader.pushFilters([LessThan(("size",), 100), GreaterThan(("path",), "a")]))
    assert left == [GreaterThan(("path",), "a")]  # the listing itself drops the large file
    assert [x[1] for part in reader.partitions() for x in part.files] == [0, 3]
    stamped = file_digests(spark, str(tmp_path), "big.bin", stamp=True).first()["digest"]
    assert stamped != want

    catalog = spark.createDataFrame([r.asDict() for r in rows.values() if r["size"] != 3] + [{**rows["small.bin"].asDict(), "path": "/gone"}])
    (big.parent / "empty.bin").write_bytes(b"now")
    found = {r["path"].rsplit("/", 1)[1]: r["change"] for r in changed_content(file_digests(spark, str(tmp_path), "*.bin", whole=1 << 20), catalog).collect()}
    assert found == {"small.bin": "new", "empty.bin": "changed", "gone": "gone"}


def test_stitched_chunks_of_odd_frames(spark):
    rows = [("a", 0, f, 0.9) for f in (3, 4, 5, 6, 6, 8)] + [("a", 50, f, 0.9) for f in (0, 1, 2)] + [("a", 50, 3, None), ("a", 50, None, 0.9), (None, 0, 1, 0.9), (None, 0, 2, 0.9)]
    frames = spark.createDataFrame(rows, "rec string, start long, n long, p double")
    out = sq.stitch_chunks(frames, ["rec"], "start", "n", "p", 0.5, 1, 10)
    assert sorted(map(str, out.collect())) == sorted(["Row(rec='a', t_ini=30, t_fin=70, n_parts=2)", "Row(rec=None, t_ini=10, t_fin=20, n_parts=1)"])
    assert sq.stitch_chunks(frames.limit(0), ["rec"], "start", "n", "p", 0.5, 1, 10).count() == 0


def test_proposal_findings_of_odd_clips(spark):
    clips = spark.createDataFrame([("m", 1, 0, 100, "why", None), ("m", 2, 50, 150, "why", True), ("m", 3, 50, 60, None, True), ("m", 4, None, None, "why", True)], "rec string, id long, t_ini long, t_fin long, reason string, repeat boolean")
    targets = spark.createDataFrame([("m", 500.0), ("z", None)], "rec string, target double")
    out = dc.proposal_findings(clips, ["rec"], "id", "id", targets, 0.1, 50, 1000)
    found = {(r["id"], r["level"], r["kind"], r["other"]) for r in out.collect()}
    assert found == {(2, "warning", "callback", 1), (3, "error", "repeats", 1), (3, "error", "repeats", 2), (3, "warning", "short", None), (3, "warning", "no_reason", None), (None, "warning", "off_target", None)}


def test_resolved_candidates_of_odd_documents(spark):
    media = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (5, "e")], "m long, identity string")
    rows = [(1, "a", "store", 2, True, 3), (1, "a", "sidecar", 2, True, 1), (1, "x", "store", 9, True, 4), (2, "b", "sidecar", None, True, 2), (2, "b", "store", 5, None, 2), (3, None, "store", 1, True, 1), (4, "d", "sidecar", 3, True, 0), (4, "d", "store", 1, True, 7)]
    found = spark.createDataFrame(rows, "m long, identity string, origin string, revision long, readable boolean, n_items long")
    mild = {r["m"]: tuple(r)[1:] for r in dc.resolve_candidates(media, found, ["m"], "identity", "sidecar").collect()}
    none = ("none", None, None, None)
    assert mild == {1: ("found", "sidecar", 2, 1), 2: ("found", "sidecar", 0, 2), 3: none, 4: none, 5: none}
    strict = {r["m"]: r["outcome"] for r in dc.resolve_candidates(media, found, ["m"], "identity", "sidecar", True).collect()}
    assert strict == {1: "found", 2: "error", 3: "none", 4: "none", 5: "none"}
    assert dc.resolve_candidates(media.limit(0), found, ["m"], "identity", "sidecar").count() == 0


def test_bundle_is_written_by_revision_in_order(spark, tmp_path):
    import pytest

    from tidemark.plans import review as rv

    long = spark.range(500).selectExpr("'r' AS rec", "id AS line_no", "concat('line ', id) AS line")
    note = spark.createDataFrame([("r", 1, None), ("s", 1, "only")], "rec string, line_no int, line string")
    lines = rv.bundle({"transcript": long, "notes": note, "empty": note.limit(0)}, ["rec"])
    path = tmp_path / "revision=1"
    assert rv.write_bundle(lines, str(tmp_path), 1, ["rec"]) == str(path)
    text = "".join(f.read_text() for f in sorted((path / "rec=r" / "view=transcript").glob("part-*.txt")))
    assert text == "".join(f"line {i}\n" for i in range(500))
    assert [f.read_text() for f in (path / "rec=r" / "view=notes").glob("part-*.txt")] == ["\n"]
    assert sorted(x.name for x in (path / "rec=s").iterdir()) == ["view=notes"]
    with pytest.raises(Exception, match="already exists"):
        rv.write_bundle(lines, str(tmp_path), 1, ["rec"])
    with pytest.raises(ValueError):
        rv.bundle({}, ["rec"])


def test_descendants_at_any_depth(spark):
    chain = [("m", i, i - 1 if i else None) for i in range(40)] + [("m", 100, 101), ("m", 101, 100), ("m", 200, 300), ("n", 1, 0)]
    items = spark.createDataFrame(chain, "rec string, id long, up long")
    roots = spark.createDataFrame([("m", 2), ("m", 300)], "rec string, id long")
    found = {tuple(r) for r in dc.descendants(items, roots, ["rec"], "id", "up").collect()}
    assert found == {("m", i) for i in range(2, 40)} | {("m", 300), ("m", 200)}
    assert dc.descendants(items, roots.limit(0), ["rec"], "id", "up").count() == 0
    assert {r["id"]: r["depth"] for r in dc.depth(items, ["rec"], "id", "up").where("rec = 'm' and id < 3").collect()} == {0: 0, 1: 1, 2: 2}
