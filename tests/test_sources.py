import pytest

from fluxtrace.sources import hdf5, manifest, upsert, vendor_csv, xlsx


def test_vendor_csv(spark, tmp_path):
    (tmp_path / "m1.csv").write_bytes("Vendor \xb5 1.0\nTime(s),AIn-1,extra,DI/O-1\n0.1,5,x,0\n0.0,4,x,1\n".encode("latin-1"))
    rows = vendor_csv.read_recording(spark, str(tmp_path / "m1.csv")).orderBy("idx").collect()
    assert [(r.rec, r.idx, r.time_s, r.ain1, r.gate405) for r in rows] == [("m1", 0, 0.1, 5.0, 0.0), ("m1", 1, 0.0, 4.0, 1.0)]  # as in the file
    (tmp_path / "bad.csv").write_text("a\nb\n")
    with pytest.raises(ValueError):
        vendor_csv.read_recording(spark, str(tmp_path / "bad.csv"))


def test_behaviour_csv(spark, tmp_path):
    (tmp_path / "behav_0_m1.csv").write_text("t,Rearing,Gate opens\n0.0,0,1\n0.1,1,0\n")
    rows = vendor_csv.read_behaviour(spark, str(tmp_path / "behav_0_m1.csv")).collect()
    assert sorted((r.time_s, r.behaviour, r.level) for r in rows) == [(0.0, "Gate opens", 1), (0.0, "Rearing", 0), (0.1, "Gate opens", 0), (0.1, "Rearing", 1)]


def test_xlsx_round_trip(spark, tmp_path):
    rows = [("m1", "CD", 1.0), ("m<2", None, 2.5)]
    path = str(tmp_path / "subjects.xlsx")
    xlsx.write_xlsx(spark.createDataFrame(rows, "Subject string, `Group` string, n double"), path, "Included")
    for frame in (xlsx.read_xlsx(spark, path, "Included"), xlsx.read_xlsx(spark, path)):
        assert frame.columns == ["Subject", "Group", "n"] and [tuple(r) for r in frame.collect()] == rows
    spark.dataSource.register(xlsx.XlsxSource)
    assert spark.read.format("xlsx").option("path", path).option("sheet", "Included").schema("Subject string, `Group` string, n double").load().count() == 2
    with pytest.raises(ValueError):
        xlsx.read_xlsx(spark, path, "Missing")


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    assert upsert.create_or_load(spark, path, "k string, v int").count() == 0
    upsert.upsert(spark, path, spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), ["k"])
    upsert.upsert(spark, path, spark.createDataFrame([("b", 3)], "k string, v int"), ["k"])
    assert sorted(map(tuple, upsert.load(spark, path).collect())) == [("a", 1), ("b", 3)]


def test_manifest(spark, tmp_path):
    for name in ("behav_0_m1.csv", "x.csv"):
        (tmp_path / name).write_text("1")
    found = manifest.files(spark, str(tmp_path))
    assert {r.name for r in manifest.scored_files(found).collect()} == {"behav_0_m1.csv"}


def test_hdf5_needs_its_library():
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            hdf5.table_of(b"")


def test_files_of_every_step(spark, tmp_path):
    """Headers with and without the vendor's line before them, and a column of row numbers."""
    (tmp_path / "d1.csv").write_text("Time(s),405 Deinterleaved,470 Deinterleaved\n0.0,1,2\n0.1,,3\n")
    rows = vendor_csv.read_recording(spark, str(tmp_path / "d1.csv"), vendor_csv.DEINTERLEAVED).orderBy("idx").collect()
    assert [(r.idx, r.ctrl, r.sig) for r in rows] == [(0, 1.0, 2.0), (1, None, 3.0)]
    (tmp_path / "t1.csv").write_text(",Time(s),405 dFF,470 dFF,Denoised dFF\n0,0.0,1,2,5\n1,0.1,1,3,6\n")
    rows = vendor_csv.read_recording(spark, str(tmp_path / "t1.csv"), vendor_csv.TRACE).orderBy("idx").collect()
    assert [(r.idx, r.ctrl, r.sig, r.denoised) for r in rows] == [(0, 1.0, 2.0, 5.0), (1, 1.0, 3.0, 6.0)]
    (tmp_path / "a1.csv").write_text(",Time(s),Denoised dFF,405nm dFF,470nm dFF,Rearing,Gate opens\n0,0.0,5,1,2,0,1\n1,0.1,6,1,3,1,0\n")
    trace, states = vendor_csv.read_aligned(spark, str(tmp_path / "a1.csv"))
    assert [tuple(r)[1:] for r in trace.orderBy("idx").collect()] == [(0, 0.0, 5.0, 1.0, 2.0), (1, 0.1, 6.0, 1.0, 3.0)]
    assert sorted(tuple(r)[1:] for r in states.collect()) == [(0, "Gate opens", 1), (0, "Rearing", 0), (1, "Gate opens", 0), (1, "Rearing", 1)]
    assert vendor_csv.shown_names(trace, vendor_csv.ALIGNED).columns == ["rec", "idx", "Time(s)", "Denoised dFF", "405nm dFF", "470nm dFF"]


def test_written_csv_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.0, 1.5), (1, 0.1, None)], "idx long, time_s double, x double")
    vendor_csv.write_csv(rows, str(tmp_path / "plain"))
    back = spark.read.option("header", True).schema("time_s double, x double").csv(str(tmp_path / "plain"))
    assert back.columns == ["time_s", "x"] and sorted(map(tuple, back.collect())) == [(0.0, 1.5), (0.1, None)]
    vendor_csv.write_csv(rows, str(tmp_path / "numbered"), index=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "numbered")).columns == ["idx", "time_s", "x"]


def test_folders_and_protocol(spark, tmp_path):
    made = manifest.lay_out(spark, str(tmp_path), "Fear", ["S1", "S2"])
    assert [(tmp_path / "Fear" / s).is_dir() for s in ("S1", "S2")] == [True, True] and made == manifest.lay_out(spark, str(tmp_path), "Fear", ["S1", "S2"])
    for name in ("a.csv", "b.csv"):
        (tmp_path / "Fear" / "S1" / name).write_text("1")
    (tmp_path / "Fear" / "S2" / "a.csv").write_text("1")
    found = manifest.folders(manifest.files(spark, str(tmp_path))).collect()
    assert [(r.folder.rpartition("/")[2], r.n) for r in found] == [("S1", 2)]
    protocol = spark.createDataFrame([("Fear", "B1", "S1,S2", "raw/x")], "task string, batch string, sessions string, data_path string")
    assert manifest.protocol_value(protocol, "Fear", "B1", "sessions") == "S1,S2"
    assert manifest.data_folder(protocol, "/d", "Fear", "B1") == "/d/B1/raw/x"
    with pytest.raises(ValueError):
        manifest.protocol_value(protocol, "Fear", "B2", "sessions")


def test_upsert_of_sniffs(spark, tmp_path):
    path, keys = str(tmp_path / "sniffs"), ["subject", "odor", "n"]
    assert upsert.create_or_load(spark, path, upsert.SNIFFS).count() == 0
    row = lambda odor, stop: spark.createDataFrame([("m1", "CD", odor, 1, (0.0, stop), [(0.5, 1.0)])], upsert.SNIFFS)
    for odor, stop in (("HC", 2.0), (None, 3.0), ("HC", 4.0), (None, 5.0)):
        upsert.upsert(spark, path, row(odor, stop), keys)
    assert {(r.odor, r.stim.stop) for r in upsert.load(spark, path).collect()} == {("HC", 4.0), (None, 5.0)}
    (tmp_path / "sniffs").rename(tmp_path / "sniffs.old")
    assert upsert.create_or_load(spark, path, upsert.SNIFFS).count() == 2


def test_each_file_has_its_own_header(spark, tmp_path):
    """Columns in another order, a name in two folders, a column that one file lacks, equal times."""
    texts = {"b1/m1.csv": "Vendor\nTime(s),AIn-1,DI/O-1\n0.0,5,0\n0.1,6,1\n0.1,7,1\n", "b2/m1.csv": "Vendor\nTime(s),DI/O-1,AIn-1\n0.0,1,8\n0.1,0,9\n", "b2/m2.csv": '"Time(s)",AIn-4\n0.0,2.5\n'}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = vendor_csv.read_recording(spark, str(tmp_path / "*" / "*.csv")).select("rec", "idx", "time_s", "ain1", "ain4", "gate405").collect()
    assert sorted(map(tuple, rows), key=repr) == [("b1/m1", 0, 0.0, 5.0, None, 0.0), ("b1/m1", 1, 0.1, 6.0, None, 1.0), ("b1/m1", 2, 0.1, 7.0, None, 1.0), ("b2/m1", 0, 0.0, 8.0, None, 1.0), ("b2/m1", 1, 0.1, 9.0, None, 0.0), ("m2", 0, 0.0, None, 2.5, None)]
    (tmp_path / "b2" / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="bad.csv"):
        vendor_csv.read_recording(spark, str(tmp_path / "b2"))


def test_scored_files_have_their_own_behaviours(spark, tmp_path):
    (tmp_path / "behav_0_m1.csv").write_text("t,Rearing,Gate opens\n0.0,0,1\n0.1,1,0\n")
    (tmp_path / "behav_0_m2.csv").write_text("t,Climbing\n0.5,1\n")
    rows = vendor_csv.read_behaviour(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("behav_0_m1", 0, 0.0, "Gate opens", 1), ("behav_0_m1", 0, 0.0, "Rearing", 0), ("behav_0_m1", 1, 0.1, "Gate opens", 0), ("behav_0_m1", 1, 0.1, "Rearing", 1), ("behav_0_m2", 0, 0.5, "Climbing", 1)]


def test_long_files_are_numbered_over_their_parts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Time(s),AIn-1\n" + "".join(f"{i % 7}.5,{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = vendor_csv.read_recording(spark, str(tmp_path)).select("idx", "ain1").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.idx, int(r.ain1)) for r in rows) == [(i, i) for i in range(5000)]


def test_upsert_keeps_old_and_takes_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert(spark, path, spark.createDataFrame([(1, 2, 3), (2, 4, 5)], "k int, a int, b int"), ["k"])
    upsert.upsert(spark, path, spark.createDataFrame([(2, 9)], "k int, a int"), ["k"])
    upsert.upsert(spark, path, spark.createDataFrame([(3, "x")], "k int, c string"), ["k"])
    rows = upsert.load(spark, path)
    assert rows.columns == ["k", "a", "b", "c"] and sorted(map(tuple, rows.collect())) == [(1, 2, 3, None), (2, 9, None, None), (3, None, None, "x")]
    assert upsert.create_or_load(spark, path, "k int, d double").columns == ["k", "a", "b", "c", "d"]


def test_a_crash_between_any_two_steps_leaves_the_table(spark, tmp_path, monkeypatch):
    path, row = str(tmp_path / "t"), lambda v: spark.createDataFrame([("a", v)], "k string, v int")
    upsert.upsert(spark, path, row(1), ["k"])

    def crash(*_):
        raise KeyboardInterrupt

    for step in ("_write", "_commit"):
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(upsert, step, crash)
            upsert.upsert(spark, path, row(2), ["k"])
        assert upsert.load(spark, path).collect() == row(1).collect()
    (tmp_path / "t" / "_commits" / f"{3:012d}").write_text('{"snap')  # cut short
    assert upsert.load(spark, path).collect() == row(1).collect()
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(upsert, "tidy", crash)
        upsert.upsert(spark, path, row(3), ["k"])
    assert upsert.load(spark, path).collect() == row(3).collect()
    upsert.upsert(spark, path, row(4), ["k"])
    assert upsert.load(spark, path).collect() == row(4).collect()
    assert len(list((tmp_path / "t").glob("snapshot-*"))) == 2


def test_two_writers_dont_lose_a_commit(spark, tmp_path, monkeypatch):
    path, row = str(tmp_path / "t"), lambda k: spark.createDataFrame([(k, 1)], "k string, v int")
    upsert.upsert(spark, path, row("a"), ["k"])
    stale = upsert._commits(spark, path)
    upsert.upsert(spark, path, row("b"), ["k"])
    with monkeypatch.context() as m, pytest.raises(Exception, match="exists"):
        m.setattr(upsert, "_commits", lambda *_: stale)
        upsert._commit(spark, path, "snapshot-x", row("c").schema)
    assert upsert.load(spark, path).count() == 2


def test_a_table_without_commits_is_read_and_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(path)
    assert upsert.create_or_load(spark, path, "k string, v int").count() == 1
    upsert.upsert(spark, path, spark.createDataFrame([("b", 2)], "k string, v int"), ["k"])
    assert sorted(map(tuple, upsert.load(spark, path).collect())) == [("a", 1), ("b", 2)]
