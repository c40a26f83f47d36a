"""Items of large JSON lists, read in small pieces."""

import json
import random

import pytest

from tallyloom.sources import json_arrays, readers


def texts(rng, n):
    alphabet = ['a', '"', "\\", ",", "[", "]", "{", "}", " ", "é", "\n", ":", '","', '\\"', "\U0001f642"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def nested(rng, depth=0):
    if depth > 2 or rng.random() < 0.4:
        return rng.choice([None, True, 1, -2.5e3, *texts(rng, 2)])
    if rng.random() < 0.5:
        return [nested(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {t: nested(rng, depth + 1) for t in texts(rng, rng.randint(0, 3))}


@pytest.mark.parametrize("block", [64, 1 << 27])
def test_items_as_json_reads_them(spark, tmp_path, block):
    """Blocks of a few bytes begin inside strings, between brackets and at escapes."""
    rng, want = random.Random(5), {}
    for n in range(8):
        values = [nested(rng) for _ in range(rng.choice([0, 1, 40, 90]))]
        lists = {"predictions": values, "more, \"lists\"": [1, [2, "]"]], "none": [], "model": "x, [y", "last": texts(rng, 3)}
        document = values if n % 2 else lists
        indent = rng.choice([None, 2])
        (tmp_path / f"f{n}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=bool(n % 3)))
        for name, items in [(None, values)] if n % 2 else [(k, v) for k, v in lists.items() if isinstance(v, list)]:
            for pos, item in enumerate(items):
                want[f"f{n}.json", name, pos] = item
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = json_arrays.items(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    section = lambda s: None if s is None else json.loads(f'"{s}"')
    got = {(r["file"].rpartition("/")[2], section(r["section"]), r["pos"]): json.loads(r["item"]) for r in rows}
    assert got == want and len(rows) == len(want)


def test_prediction_texts(spark, tmp_path):
    values = texts(random.Random(3), 300)
    (tmp_path / "p.json").write_text(json.dumps({"model": "m", "predictions": values, "references": ["no"]}))
    rows = readers.text_list(spark, str(tmp_path), "predictions").collect()
    assert [r["predictions"] for r in sorted(rows)] == values
