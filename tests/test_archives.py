import zipfile

from twinlens.sources import archives


def test_members_of_archives_and_broken_ones(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", "id,name\n" + "".join(f"{i},name {i}\r\n" for i in range(25)))
        z.writestr("dir/two.csv", 'id,name\n100,"a, b"\nx,c')
        z.writestr("empty.csv", "")
        z.writestr("other.txt", "1,2\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("three.csv", "id,name\n" + "7,seven\n" * 30)
        z.writestr("four.csv", "id,name\n8,eight\n")
    raw = bytearray((tmp_path / "b.zip").read_bytes())
    raw[raw.find(b"7,seven") + 50] ^= 1  # the checksum of three.csv no longer fits
    (tmp_path / "b.zip").write_bytes(raw)
    (tmp_path / "c.zip").write_bytes(b"no archive")
    monkeypatch.setattr(archives, "LINES", 7)
    rows, errors = archives.read_zipped_csv(spark, f"{tmp_path}/*.zip", "id long, name string")
    got = sorted((r.member, r.id, r.name) for r in rows.collect() if r.id is not None)
    assert got == sorted([("one.csv", i, f"name {i}") for i in range(25)] + [("dir/two.csv", 100, "a, b"), ("four.csv", 8, "eight")])
    assert rows.where("id is null").select("name").first().name == "c"
    assert sorted((r.path.rsplit("/", 1)[1], r.member) for r in errors.collect()) == [("b.zip", "three.csv"), ("c.zip", None)]
    tsv, none = archives.read_zipped_csv(spark, f"{tmp_path}/a.zip", "a int, b int", "*.txt", header=False)
    assert [(r.a, r.b) for r in tsv.collect()] == [(1, 2)] and none.count() == 0
