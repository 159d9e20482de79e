"""Batches screened against kept snapshots, held against plain Python."""

import hashlib
from collections import defaultdict

from glossaria.llm import snapshots
from test_edges import ROWS, SAME, frame


def test_a_batch_against_snapshots(spark, tmp_path):
    olds = [[(1, "a b c"), (2, "only here"), (9, "a b c"), (None, "null id")], [(20, "a b c"), (21, SAME), (22, None)], []]
    paths = [str(tmp_path / str(i)) for i in range(3)]
    for rows, path in zip(olds, paths, strict=True):
        snapshots.write_snapshot(frame(spark, rows), path, bucket_rows=2)
    batch = ROWS + [(500 + i, f"t{i % 40}") for i in range(300)] + [(77, "null id")]
    got = snapshots.known_texts(frame(spark, batch).repartition(4), paths).collect()
    groups = defaultdict(list)
    for i, t in batch:
        groups[t or ""].append(i)
    want = []
    for i, t in batch:
        text, ids = t or "", groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        at = next((k for k, rows in enumerate(olds) if text in {x or "" for _, x in rows}), None)
        known = None if at is None else max((x for x, y in olds[at] if (y or "") == text and x is not None), default=None)
        want.append((i, keep, len(ids), i == keep and at is None, hashlib.sha256(text.encode()).hexdigest(), at, known))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert {r["snapshot"] for r in got} == {None, 0, 1}
    assert snapshots.known_texts(frame(spark, []), paths).count() == 0
    alone = snapshots.known_texts(frame(spark, batch), []).collect()
    assert all(r["snapshot"] is None for r in alone) and sum(r["kept"] for r in alone) >= len(groups)
