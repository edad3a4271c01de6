"""Long texts in blocks against the same texts masked whole."""

import random

import pytest

from cloakframe import Policy, mask_with_stats
from cloakframe.sources import blocks

POLICY = Policy.default("s")


def whole(spark, text):
    row = mask_with_stats(spark.createDataFrame([(text,)], "text string"), POLICY).first()
    return row.text, row.matches_found, row.matches_applied, dict(row.detector_counts)


def in_blocks(spark, path, **options):
    rows = blocks.mask_text_blocks(blocks.read_text_blocks(spark, str(path), **options), POLICY).collect()
    rows.sort(key=lambda r: (r.place.block, r.place.line))
    counts = {}
    for r in rows:
        for name, n in r.detector_counts.items():
            counts[name] = counts.get(name, 0) + n
    found, applied = (sum(r[c] for r in rows) for c in ("matches_found", "matches_applied"))
    return ("".join(r.text for r in rows), found, applied, counts), rows


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sensitive(rnd, separators, n):
    parts = ["a@mail.ru", "ключ=b.c@mail.ru", "7707083893", "40802810538320000272", "+7 (999) 123-45-67", "10.0.0.1", "plain", "Договор №ABCORG0006", "=", "é"]
    return "".join(rnd.choice(parts) + rnd.choice(separators) for _ in range(n))


@pytest.mark.parametrize("separators, separator", [(["\n", " ", "\r\n"], "\n"), ([" ", ", "], " "), (["-", ";"], "\n")])
@pytest.mark.parametrize("end", ["", "\n"])
def test_blocks_add_up_to_the_whole_text(spark, tmp_path, small_ranges, separators, separator, end):
    """Also where blocks end inside records, and where ranges end inside a span."""
    text = sensitive(random.Random(len(separators) + len(end)), separators, 900) + end
    (tmp_path / "a.txt").write_bytes(text.encode())
    got, rows = in_blocks(spark, tmp_path, block_chars=700, halo_chars=300, separator=separator)
    assert got == whole(spark, text)
    assert len(rows) > 10
    if separators[0] == "\n":
        assert len({r.place.block for r in rows}) > 3  # several tasks read the one file


def test_odd_files(spark, tmp_path, small_ranges):
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "mark.txt").write_bytes("﻿mail a@mail.ru".encode())
    (tmp_path / "bytes.txt").write_bytes(b"\xff\xfe a@mail.ru \xd0")
    (tmp_path / "lines.txt").write_bytes(b"\n\n\n")
    rows = blocks.read_text_blocks(spark, str(tmp_path)).collect()
    texts = {r.source.rsplit("/", 1)[-1]: r.text for r in rows}
    assert texts == {"mark.txt": "mail a@mail.ru", "bytes.txt": "�� a@mail.ru �", "lines.txt": "\n\n\n"}
    with pytest.raises(ValueError):
        blocks.read_text_blocks(spark, str(tmp_path), block_chars=10, halo_chars=5)


def test_a_record_of_many_blocks(spark, tmp_path):
    """One line of 6 MB: cut into blocks in one go, every address masked."""
    line = ("user a@mail.ru of " + "x" * 41 + " ") * 100_000
    (tmp_path / "a.txt").write_text(line)
    masked = blocks.mask_text_blocks(blocks.read_text_blocks(spark, str(tmp_path), block_chars=1 << 16, halo_chars=1000), POLICY)
    rows = masked.selectExpr("matches_applied", "length(text) AS n", "text LIKE '%a@mail.ru%' AS left").collect()
    assert len(rows) > 50 and sum(r.matches_applied for r in rows) == 100_000 and not any(r.left for r in rows)
