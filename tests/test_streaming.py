"""A stream of episodes into a store, delivered twice."""

import json
from datetime import datetime, timezone

from palimpsest.sources.store import Store
from palimpsest.streaming.ingest import stream_episodes


def test_stream_commits_each_batch_and_replays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": f"e{i}", "kind": "note", "content": f"text {i}"} for i in range(3)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    store = Store(spark, str(tmp_path / "db"))
    for checkpoint in ("c1", "c2"):  # a new checkpoint delivers everything again
        stream = spark.readStream.schema("id string, kind string, content string").json(str(tmp_path / "in"))
        query = stream_episodes(stream, store, str(tmp_path / checkpoint), clock=lambda: datetime(2026, 1, 1, tzinfo=timezone.utc))
        assert query.awaitTermination(120)
        assert sorted(r["id"] for r in store.load().episodes.collect()) == ["e0", "e1", "e2"]
