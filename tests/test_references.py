import os

from glossweave.operators import references


def test_second_run_reads_changed_files_only(spark, tmp_path, monkeypatch):
    folder, table = tmp_path / "files", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "a.txt").write_bytes("﻿ first \r\nline ".encode())
    (folder / "b.txt").write_bytes(b"x" * 50)
    (folder / "bad.txt").write_bytes(b"ok \xff end")
    (folder / "empty.txt").write_bytes(b"")
    read: list[int] = []
    plain = references.cut
    monkeypatch.setattr(references, "cut", lambda rows, n: (read.append(rows.count()), plain(rows, n))[1])
    name = lambda rows: {os.path.basename(r.path): (r.text, r.truncated, r.reused) for r in rows.collect()}
    first = name(references.refresh_folder(spark, str(folder), table, 20))
    assert first == {"a.txt": ("first \nline", False, False), "b.txt": ("x" * 20, True, False), "bad.txt": ("ok � end", False, False)}
    (folder / "b.txt").write_bytes(b"new text")
    (folder / "bad.txt").unlink()
    second = name(references.refresh_folder(spark, str(folder), table, 20))
    assert second == {"a.txt": ("first \nline", False, True), "b.txt": ("new text", False, False)}
    third = name(references.refresh_folder(spark, str(folder), table, 20))
    assert all(r[2] for r in third.values()) and read == [3, 1, 0]
