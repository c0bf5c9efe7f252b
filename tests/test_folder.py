"""Folders and their manifests read as a data source."""

from __future__ import annotations

import pytest

from gleaner.sources import folder
from gleaner.sources.corpus import parse_files


def write(root, files: dict[str, str | bytes]) -> str:
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


FILES = {
    "a.md": "# One\n\nfirst line", "deep/er/b.TXT": "plain\n\ntext", "deep/c.html": "<h1>T</h1><p>x</p>", "empty.txt": "", "bad.txt": b"caf\xe9", "no.csv": "1,2", ".hidden.md": "x", "d.pdf": b"%PDF", "none": "x",
    "_sources.yaml": "sources:\n  a.md: {source_id: one, status: verified, version: 2, url: null}\n  deep/c.html: {authority: community, other: x}\n  gone.md: {status: verified}\n",
}


def test_rows_and_defaults(spark, tmp_path):
    rows = {r["rel_path"]: r for r in folder.read_folder(spark, write(tmp_path, FILES), language="en").collect()}
    assert sorted(rows) == ["a.md", "bad.txt", "d.pdf", "deep/c.html", "deep/er/b.TXT", "empty.txt"]
    assert tuple(rows["a.md"]) == ("a.md", ".md", "one", "official", "verified", "en", None, "2", "# One\n\nfirst line")
    assert tuple(rows["deep/er/b.TXT"]) == ("deep/er/b.TXT", ".txt", "deep/er/b", "official", "review_required", "en", None, None, "plain\n\ntext")
    assert rows["deep/c.html"]["authority"] == "community" and rows["deep/c.html"]["status"] == "review_required"
    assert rows["empty.txt"]["text"] == "" and rows["bad.txt"]["text"] == "caf�" and rows["d.pdf"]["text"] is None


def test_parts_by_bytes_and_columns(spark, tmp_path):
    root = write(tmp_path, {f"d{k % 3}/f{k}.txt": f"text {k}\n" * 10 for k in range(40)})
    df = folder.read_folder(spark, "file://" + root, partBytes="300")
    assert 8 <= df.rdd.getNumPartitions() <= 10
    assert df.where("text LIKE 'text 7%'").select("source_id").collect()[0][0] == "d1/f7" and df.count() == 40
    assert parse_files(df.where("rel_path < 'd1'").select("source_id", "suffix", "text")).count() == 14


def test_absent_and_empty_folders(spark, tmp_path):
    assert folder.read_folder(spark, str(tmp_path / "gone")).count() == 0
    assert folder.read_folder(spark, write(tmp_path, {"_sources.yml": ""})).count() == 0
    with pytest.raises(Exception, match="does not exist"):
        folder.read_folder(spark, str(tmp_path / "gone"), required="true").count()


@pytest.mark.parametrize("files, message", [
    ({"_sources.yaml": "", "_sources.yml": ""}, "several manifests"),
    ({"_sources.yaml": "a.md: {status: verified}\na.md: {status: draft}\n"}, "more than once"),
    ({"_sources.yaml": "- a.md\n"}, "maps paths to fields"),
    ({"_sources.yaml": "a.md: verified\n"}, "maps paths to fields"),
])
def test_manifests_that_are_refused(spark, tmp_path, files, message):
    with pytest.raises(Exception, match=message):
        folder.read_folder(spark, write(tmp_path, {"a.md": "x", **files})).count()
