"""Schemas of recorded runs, trials, trajectories and live events."""

from __future__ import annotations

STEP = "struct<index int, thought string, command string, exit_code int, output string, duration double>"
MESSAGE = "struct<role string, content string, tool_calls variant, tool_call_id string>"
TRAJECTORY = (f"struct<steps array<{STEP}>, finished boolean, stop_reason string, summary string, llm_calls int, "
              f"prompt_tokens bigint, completion_tokens bigint, error string, messages array<{MESSAGE}>>")
TRIAL_RESULT = (
    "task string, mode string, passed boolean, tests_passed boolean, test_output string, duration double, "
    "error string, violation string, tampering array<string>, changed_files array<string>, peak_disk_mb double, "
    f"solution_output string, trajectory {TRAJECTORY}")
TRIAL_FILE = f"model string, instruction string, status string, {TRIAL_RESULT}"
RUNS = ("id string, model string, base_url string, max_steps int, limits map<string,string>, status string, "
        "created_at timestamp, finished_at timestamp")
TRIALS = ("id string, run_id string, task string, trial_no int, status string, steps int, duration float, "
          "detail string, result variant, started_at timestamp, finished_at timestamp")
# One wide, nullable row per live event; `type` is trial, step or run. `seq` and `us` order the feed.
EVENT = ("seq bigint, us bigint, run_id string, type string, id string, trial_id string, status string, "
         f"steps int, duration double, detail string, step {STEP}")
SALES = "region string, quantity int, price double"
CHANGELOG = "seq bigint, subject string, path string, content string"
INVENTORY = "path string, is_dir boolean, owner string, `group` string, mode int"
