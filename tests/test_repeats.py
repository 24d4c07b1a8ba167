from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

from wicara.streaming.feed import mark_repeats, read_feed, write_feed

SCHEMA = "id long, at timestamp, text string, y long"
START = datetime(2026, 1, 1)


def land(folder, number, rows):
    lines = [json.dumps({"id": i, "at": (START + timedelta(minutes=m)).isoformat(), "text": t, "y": y}) for i, m, t, y in rows]
    file = folder / f"{number:03d}.json"
    file.write_text("\n".join(lines))
    # files of one millisecond have no order of arrival
    os.utime(file, (START.timestamp() + number, START.timestamp() + number))


def by_hand(rows):
    seen, out = {}, []
    for i, m, t, y in sorted(rows, key=lambda r: (r[1], r[0])):
        first, labels = seen.setdefault(t, (i, set()))
        labels.update({y} - {None})
        out.append((i, first, i == first, len(labels) > 1))
    return sorted(out)


def marked(df):
    return sorted((r["id"], r["first_id"], r["is_first"], r["conflict"]) for r in df.collect())


def test_stream_after_a_restart_equals_the_table(spark, tmp_path):
    """Repeats and conflicts across micro-batches; the second half lands after a stop."""
    r = random.Random(4)
    texts = [None, "", *(f"text {i}" for i in range(12))]
    rows = [(i, i // 3, r.choice(texts), r.choice([0, 0, 0, 1, None])) for i in range(160)]
    landed, out, state = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "state")
    landed.mkdir()
    feed = lambda: mark_repeats(read_feed(spark, str(landed), SCHEMA, max_files=1), "text", "id", "at", "y")
    for half in (rows[:80], rows[80:]):
        for n in range(0, 80, 40):
            land(landed, half[n][0], half[n : n + 40])
        write_feed(feed(), out, state, once=True).awaitTermination()
    table = mark_repeats(spark.read.schema(SCHEMA).json(str(landed)), "text", "id", "at", "y")
    want = by_hand(rows)
    assert marked(table) == want
    assert marked(spark.read.parquet(out)) == want
    assert any(c for *_, c in want) and not all(f for _, _, f, _ in want)


def test_state_ends_and_late_posts_give_no_row(spark, tmp_path):
    landed, out, state = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "state")
    landed.mkdir()
    steps = [[(1, 0, "a", 0)], [(2, 500, "b", 0)], [(3, 501, "a", 1), (4, 3, "b", 0)], [(5, 502, "a", 1)]]
    for n, rows in enumerate(steps):
        land(landed, n, rows)
        feed = mark_repeats(read_feed(spark, str(landed), SCHEMA, max_files=1), "text", "id", "at", "y", keep="1 hour")
        write_feed(feed, out, state, once=True).awaitTermination()
    # post 4 is more than an hour behind post 2; text a starts anew long after post 1
    assert marked(spark.read.parquet(out)) == [(1, 1, True, False), (2, 2, True, False), (3, 3, True, False), (5, 3, False, False)]


def test_a_table_in_a_folder_of_part_files_is_a_feed(spark, tables, tmp_path):
    from wicara.catalog import QUERIES

    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query, columns in (("repeat_stream", 5), ("feed_stream", 6)):
        whole = sorted(QUERIES[query](spark, tables).collect())
        assert len(whole[0]) == columns
        assert sorted(QUERIES[query](spark, str(tmp_path)).collect()) == whole


def test_odd_tables(spark):
    rows = [(1, None, "a", 0), (2, START, "a", 1), (3, START, "a", 1), (4, START, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert marked(mark_repeats(df, "text", "id", "at", "y")) == [(2, 2, True, False), (3, 2, False, False), (4, 4, True, False)]
    assert marked(mark_repeats(df, "text", "id", "at")) == [(2, 2, True, False), (3, 2, False, False), (4, 4, True, False)]
    assert mark_repeats(df.limit(0), "text", "id", "at", "y").collect() == []
