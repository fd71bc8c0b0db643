"""The commands end to end, on one store."""

import io
import json

from palimpsest.cli import main


def run(spark, *argv, status=0):
    out = io.StringIO()
    assert main(list(argv), spark, out) == status, out.getvalue()
    return json.loads(out.getvalue()) if out.getvalue() else None


def test_commands(spark, tmp_path):
    db = ("--db", str(tmp_path / "db"))
    assert run(spark, "init", *db)["version"]
    made = run(spark, "ingest", "episode", *db, "--kind", "note", "--content", "Alpha team owns the needle", "--source-kind", "chat", "--observed-at", "2026-01-02T00:00:00Z")
    assert made["id"] == "ep_000001"
    fact = run(spark, "fact", "assert", *db, "--predicate", "OWNS", "--upsert-subject", "--subject-type", "Team", "--subject-name", "Alpha", "--value-text", "needle", "--supporting-episodes", "ep_000001")
    assert fact["id"] == "fact_000001" and fact["subject_id"] == "team:alpha" and fact["observed_at"].startswith("2026-01-02")
    found = run(spark, "search", *db, "--query", "needle", "--type", "fact,episode", "--mode", "keyword", "--include-related")
    assert [r["record_id"] for r in found["rows"]] == ["fact_000001", "ep_000001"] and [r["id"] for r in found["included"]["entities"]] == ["team:alpha"]
    by_index = run(spark, "search", *db, "--query", "needle", "--mode", "keyword", "--index", str(tmp_path / "index"))
    assert {r["record_id"] for r in by_index["rows"]} == {"fact_000001", "ep_000001"}
    assert run(spark, "index", "status", *db, "--root", str(tmp_path / "index"))["fresh"]
    moved = run(spark, "fact", "supersede", *db, "--id", "fact_000001", "--predicate", "OWNS", "--subject-id", "team:alpha", "--value-text", "thread", "--supporting-episodes", "ep_000001", "--reason", "moved")
    assert moved == {"old_id": "fact_000001", "new_id": "fact_000002"}
    assert not run(spark, "index", "status", *db, "--root", str(tmp_path / "index"))["fresh"]
    assert run(spark, "fact", "retract", *db, "--id", "fact_000002", "--reason", "wrong")["status"] == "retracted"
    assert [r["id"] for r in run(spark, "fact", "lookup", *db, "--include-inactive")["rows"]] == ["fact_000001", "fact_000002"]
    assert [r["event_type"] for r in run(spark, "timeline", *db, "--entity", "team:alpha")["rows"]].count("fact_retracted") == 1
    assert {n["id"] for n in run(spark, "provenance", *db, "--fact", "fact_000002", "--include-inactive")["nodes"]} >= {"fact_000001", "fact_000002", "ep_000001"}
    assert {n["id"] for n in run(spark, "neighborhood", *db, "--episode", "ep_000001")["nodes"]} == {"ep_000001", "src:default:chat:"}
    assert run(spark, "inspect", "counts", *db) == {"sources": 1, "episodes": 1, "entities": 1, "facts": 2}
    assert "facts" in run(spark, "inspect", "schema", *db)
    assert run(spark, "context", *db, "--query", "needle")[0]["kind"] == "hit"
    assert run(spark, "get", *db, "--kind", "episode", "--id", "nothing", status=4)["error"]["code"] == "QUERY_FAILED"
    assert run(spark, "entity", "get", *db, "--id", "nothing", status=3)["error"]["code"] == "ENTITY_NOT_FOUND"
    assert run(spark, "provenance", *db, "--fact", "nothing", status=3)["error"]["code"] == "FACT_NOT_FOUND"
    assert run(spark, "admin", "compact", *db, "--apply", status=2)["error"]["code"] == "INPUT_INVALID"
    assert main(["fly"], spark, io.StringIO()) == 2


def test_export_import_and_benches(spark, tmp_path):
    db, other = ("--db", str(tmp_path / "db")), ("--db", str(tmp_path / "other"))
    made = run(spark, "bench", "ingest", *db, "--episodes", "20", "--facts-per-episode", "2")
    assert made["facts"] == 40 and made["facts_per_second"] > 0
    out = str(tmp_path / "out")
    assert run(spark, "admin", "export", *db, "--out", out, "--importable") == {"out": out}
    assert run(spark, "admin", "import", *other, "--in", out, status=2)["error"]["code"] == "INPUT_INVALID"
    assert run(spark, "admin", "import", "--confirm", *other, "--in", out)["version"]
    assert run(spark, "inspect", "counts", *other) == run(spark, "inspect", "counts", *db)
    assert run(spark, "bench", "lifecycle", *other, "--iterations", "5")["operations_per_second"] > 0
    timed = run(spark, "bench", "query", *other, "--query", "value", "--iterations", "2")
    assert set(timed["search"]) == {"p50_ms", "p95_ms", "p99_ms"}
    assert run(spark, "bench", "ingest", *db, "--episodes", "0", status=2)["error"]["code"] == "INPUT_INVALID"
    assert run(spark, "admin", "checkpoint", *db)["version"] and run(spark, "migrate", *db)
