from pathlib import Path

from gondola.session import scratch_root
from workload import tables as t


def test_files_are_made_and_listed_in_portions(spark, monkeypatch):
    kinds = (".jpg", ".JPEG", ".Png", ".txt", ".webp")
    paths = [f"/flyers/{1995 + i % 5}-03/f{i}{kinds[i % 7 % 5]}" for i in range(90)]
    paths += paths[:10] + [f"/flyers/1994-0{m}/f9000.jpg" for m in (1, 2, 3)]  # files named by several rows
    root = Path(scratch_root(spark))
    before, most, plain = set(root.rglob("f*.*")), [], t.write_files

    def write(manifest, folder):
        plain(manifest, folder)
        most.append(len(set(root.rglob("f*.*")) - before))

    monkeypatch.setattr(t, "write_files", write)
    manifest = spark.createDataFrame([(p,) for p in paths], "caminho_arquivo string")
    found = sorted(map(tuple, t.listed_files(spark, manifest, portion_files=20).collect()))
    taken = {p.rsplit("/", 1)[1] for p in paths if p < "/flyers/1998" and p.endswith((".jpg", ".JPEG", ".webp"))}
    assert found == sorted((name, len(name)) for name in taken)
    assert len(most) == 6 and sum(most) == 91 and max(most) < 40
    assert set(root.rglob("f*.*")) == before
    assert t.listed_files(spark, manifest.limit(0)).collect() == []


def test_files_of_a_folder_give_way_to_new_ones(spark, tmp_path):
    def made(*numbers):
        paths = [f"/flyers/{1996 + i % 4}-01/f{i}.jpg" for i in numbers]
        t.write_files(spark.createDataFrame([(p,) for p in paths], "caminho_arquivo string"), str(tmp_path / "flyers"))
        found = {f.name: f for f in tmp_path.rglob("*") if f.is_file()}
        assert {n: f.read_text() for n, f in found.items()} == {n: n for n in (p.rsplit("/", 1)[1] for p in paths)}
        assert all((f.parent.name == "depois") == (int(n[1:-4]) % 4 > 1) for n, f in found.items())
        return {f.stat().st_ino for f in found.values()}

    first = made(*range(200))
    second = made(*range(9900, 10_060), 9900, 9901)  # longer names, fewer files, some named twice
    assert len(second) == 160 and len(second & first) > 100
    assert len(made(*range(300))) == 300
    assert len(made(3, 4)) == 2 and not [*tmp_path.glob("*-antes")]
