"""These must equal the recorded harness's own for results to match."""

# Statuses, in the order they are documented.
TRIAL_STATUSES = ("queued", "running", "cancelled", "PASS", "FAIL", "TAMPER", "LIMIT", "ERROR")
RUN_STATUSES = ("queued", "running", "done", "cancelled")
GRADED = ("PASS", "FAIL", "TAMPER", "LIMIT", "ERROR")
FAILED = ("FAIL", "TAMPER", "LIMIT", "ERROR")
OPEN = ("queued", "running")
MODES = ("oracle", "noop", "agent")

# Paths whose change counts as tampering.
PROTECTED_PATHS = (
    "/bin", "/sbin", "/usr/bin", "/usr/sbin", "/usr/local/bin", "/usr/libexec",
    "/lib", "/lib64", "/usr/lib", "/usr/local/lib",
    "/etc/ld.so.preload", "/etc/ld.so.conf", "/etc/ld.so.conf.d",
)
CHANGES_RECORDED = 200

# Stop rules of a trial.
OUTPUT_CHARS = 4000
TOKEN_BUDGET = 500_000
MAX_STEPS = 30
REPEAT_WINDOW = 10
REPEAT_WARN = 3
REPEAT_STOP = 5
PROSE_STOP = 2
TOOL_NAMES = ("run_shell", "finish")
BAD_CALL_TEXT = "error: call run_shell with a non-empty 'command' string, or call finish."

# Default limits of one trial.
LIMITS = {
    "memory_mb": 512, "cpus": 1.0, "pids": 256, "disk_mb": 1024, "max_file_mb": 256,
    "open_files": 1024, "command_timeout": 60, "step_timeout": 120, "trial_timeout": 900,
    "max_output_kb": 1024, "network": False,
}
SHOWN_LIMITS = ("memory_mb", "cpus", "pids", "disk_mb", "trial_timeout", "network")

# Accepted ranges of a run request (lowest, highest); cpus excludes its lowest.
REQUEST_RANGES = {
    "trials": (1, 20), "max_steps": (1, 200), "memory_mb": (64, 8192), "cpus": (0, 8),
    "disk_mb": (10, 20480), "trial_timeout": (10, 7200),
}

# Files every task folder holds, in the order they are reported missing.
TASK_FILES = ("instruction.md", "solution.sh", "environment/Dockerfile", "tests/run_tests.sh")

# Worker heartbeat and live feed lifetimes, in seconds.
HEARTBEAT_SECONDS = 30
LIVE_STEPS_SECONDS = 24 * 3600

# Replay pace in seconds per step, and hold of the last frame.
REPLAY_SECONDS = 1.2
LAST_FRAME_SECONDS = 2.5
