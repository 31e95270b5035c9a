"""The tables of evidence. Every table carries change_id; joins between them are on (change_id, path)."""

from __future__ import annotations

#: Spark DDL by table.
TABLES = {
    "file_edit": "change_id string, file_ord int, path string, new_content string",
    "base_file": "change_id string, path string, content string",
    "raw_diff": "change_id string, text string",
    "changed_line": "change_id string, file_ord int, path string, pos int, line int",
    "statement_run": "change_id string, path string, rfirst int, rlast int, owner int",
    "mapped_file": "change_id string, path string, error string",
    "coverage_line": "change_id string, path string, line int, status string",
    "missing_branch": "change_id string, path string, src_line int, dst_line int",
    "measured_file": "change_id string, path string",
    "gate_result": "change_id string, gate string, passed boolean, blocking_reason string, reason_code string",
    "test_run": "change_id string, run_kind string, attempt int, exit_code int, timed_out boolean, stdout string, stderr string",
    "import_ref": "change_id string, side string, path string, module string",
    "mutant": "change_id string, path string, line int, col int, end_col int, orig string, repl string, op string, kind string",
    "mutant_outcome": "change_id string, path string, line int, col int, outcome string",
    "stability_run": "change_id string, run_no int, seed string, timed_out boolean, exit_code int, stdout string, stderr string",
    "repo_file": "change_id string, path string, kind string",
}

#: An unattributable line's owner.
UNATTRIBUTABLE = -1
VERDICTS = ("SAFE", "UNSAFE", "UNPROVEN")
TRISTATE = ("true", "false", "unknown")
