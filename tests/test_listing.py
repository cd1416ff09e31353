"""The driver holds no names of many files: tasks list their own shares."""

import os

from tilewright.sources import graymaps


def test_shares_of_many_files(tmp_path, monkeypatch):
    os.makedirs(tmp_path / "s" / "deep" / "_hidden")
    os.makedirs(tmp_path / "s" / "_job")
    wanted = {str(tmp_path / "s" / "deep" / "x.pgm")} | {str(tmp_path / "s" / f"{k}.pgm") for k in range(60)}
    for name in [*wanted, *(str(tmp_path / "s" / n) for n in ("other.txt", "_a.pgm", "deep/_hidden/y.pgm", "_job/z.pgm"))]:
        with open(name, "wb") as f:
            f.write(b"P5 1 1 255 0")
    for folder in (str(tmp_path / "s"), f"{tmp_path}/s/", f"file://{tmp_path}/s"):
        whole = graymaps.HeaderReader(folder, 7)
        assert [len(p.names) for p in whole.partitions()] == [7] * 8 + [5]
        with monkeypatch.context() as m:
            m.setattr(graymaps, "HELD", 20)
            m.setattr(graymaps, "SHARES", 5)
            parts = whole.partitions()
            assert len(parts) == 5 and not any(p.names for p in parts)
            got = [r[6].removeprefix("file://") for p in parts for r in whole.read(p)]
            assert len(got) == 61 and set(got) == wanted
            one = graymaps.HeaderReader(folder, 7)
            assert list(one.pushFilters([graymaps.StringStartsWith(("file",), f"{folder.rstrip('/')}/1")])) == []
            assert sum(len(p.names) for p in one.partitions()) == 11
