"""Pruned listings of source trees, contained access, and derived artifacts that follow their sources."""

import os

import pytest
from pyspark.sql import functions as F

from corvana.functions import references as R
from corvana.operators import derived
from corvana.sources import listing, versioned


def tree(root, folders=40, files=25):
    for k in range(folders):
        top = root / f"a{k % 7}" / f"b{k}"
        top.mkdir(parents=True)
        for n in range(files):
            (top / f"f{n}.txt").write_text("x" * n)
    for name in ("build", "a1/cache", ".git", "a2/node_modules"):
        (root / name / "deep").mkdir(parents=True)
        (root / name / "deep" / "hidden.txt").write_text("no")
    (root / "note.log").write_text("log")
    (root / "a0" / "note.log").write_text("log")


def test_ignored_folders_are_never_opened(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    tree(root)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "secret.txt").write_text("s")
    (root / "link").symlink_to(tmp_path / "outside")
    (root / "a0" / "loop").symlink_to(root)
    (root / "a0" / "l.txt").symlink_to(tmp_path / "outside" / "secret.txt")
    got = listing.listing(spark, f"file://{root}", f"file://{tmp_path}/scratch", R.parse_ignore("*.log\nbuild/\ncache"))
    want = sorted(f"a{k % 7}/b{k}/f{n}.txt" for k in range(40) for n in range(25))
    assert sorted(r.path for r in got.sources().collect()) == want
    opened = {r.path for r in got.opened.collect()}
    assert opened == {"", *(f"a{k}" for k in range(7)), *(f"a{k % 7}/b{k}" for k in range(40))}
    report = {(r.state, r.rule): (r.n, r.bytes, r.examples) for r in got.report().collect()}
    assert report["indexed", None][:2] == (1000, 40 * sum(range(25))) and report["indexed", None][2] == want[:8]
    assert report["ignored", 1] == (2, 6, ["a0/note.log", "note.log"]) and report["ignored", 2][2] == ["build"] and report["ignored", 3][2] == ["a1/cache"]
    assert report["skipped", None][2] == [".git", "a2/node_modules"] and report["link", None][0] == 3
    assert listing.listing(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/scratch2").sources().count() == 0


def test_contained_access(tmp_path):
    root, out = tmp_path / "r", tmp_path / "o"
    (root / "d").mkdir(parents=True)
    out.mkdir()
    (root / "d" / "f").write_text("yes")
    (out / "f").write_text("no")
    (root / "l").symlink_to(out)
    (root / "d" / "m").symlink_to(out / "f")
    os.mkfifo(root / "p")
    handle = listing.open_contained(str(root / "d" / "f"), [str(out), str(root)])
    assert os.read(handle, 9) == b"yes"
    os.close(handle)
    for bad in (out / "f", root / "l" / "f", root / "d" / "m", root / "d", root / "p", root / "d" / ".." / ".." / "o" / "f", root / "none", root):
        with pytest.raises(listing.NotContained):
            listing.open_contained(str(bad), [str(root)])


def test_only_changed_keys_are_built(spark, tmp_path):
    result = versioned.Table(spark, f"{tmp_path}/r", "conv_id long, text string")
    known = versioned.Table(spark, f"{tmp_path}/k", "conv_id long, fingerprint string")
    rows, seen = {(c, t): f"text {c} {t}" for c in range(12) for t in range(4)}, []

    def build(sources):
        seen.append(sorted(r.conv_id for r in sources.select("conv_id").distinct().collect()))
        return sources.groupBy("conv_id").agg(F.max("text").alias("text"))

    def run():
        frame = spark.createDataFrame([(c, t, x) for (c, t), x in rows.items()], "conv_id long, turn long, text string").repartition(3)
        told = derived.refresh(frame, "conv_id", build, result, known)
        want = {}
        for (c, _), x in rows.items():
            want[c] = max(want.get(c, ""), x)
        assert {r.conv_id: r.text for r in result.read().collect()} == want and result.read().count() == len(want)
        return told.built, told.kept, told.removed

    assert run() == (12, 0, 0) and run() == (0, 12, 0) and len(seen) == 1
    rows[5, 2] = "text changed"
    assert run() == (1, 11, 0) and seen[-1] == [5]
    rows[20, 0] = "new"
    for t in range(4):
        del rows[3, t]
    files = set(result.live())
    assert run() == (1, 11, 1) and seen[-1] == [20] and files & set(result.live())
    rows[7, 0], rows[7, 1] = rows[7, 1], rows[7, 0]  # the turns swap their texts
    assert run() == (1, 11, 0)
