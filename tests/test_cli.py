"""The command-line ingest job, in its own process."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_cli_ingest(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text('10.0.0.1 - - [25/Aug/2025:06:04:00 +0000] "GET /a HTTP/1.1" 500 5 "-" "-"\nbad\n')
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    out = subprocess.run(
        [sys.executable, "-m", "logloom", "ingest", str(raw), "cli.logs", "--quarantine", "cli.rejects"],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    result = json.loads([ln for ln in out.stdout.splitlines() if ln.startswith("{")][-1])
    assert result == {"rows_written": 1, "rows_quarantined": 1}


def test_cli_single_pass_ingest(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.log").write_text('10.0.0.1 - - [25/Aug/2025:06:04:00 +0000] "GET /a HTTP/1.1" 500 5 "-" "-"\nbad\n')
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    out = subprocess.run(
        [sys.executable, "-m", "logloom", "ingest", str(raw), "cli.logs", "--quarantine", "cli.rejects",
         "--single-pass", str(tmp_path / "lake")],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    result = json.loads([ln for ln in out.stdout.splitlines() if ln.startswith("{")][-1])
    assert result == {"rows_written": 1, "rows_quarantined": 1}
    assert (tmp_path / "lake" / "outcome=logs").is_dir() and (tmp_path / "lake" / "outcome=rejects").is_dir()


def run_cli(cwd, *args):
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    out = subprocess.run([sys.executable, "-m", "logloom", *map(str, args)], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return json.loads([ln for ln in out.stdout.splitlines() if ln.startswith("{")][-1])


def test_cli_files_by_ledger(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(3):
        (raw / f"{i}.log").write_text(f'10.0.0.{i} - - [25/Aug/2025:06:04:00 +0000] "GET /a HTTP/1.1" 500 5 "-" "-"\nbad\n')
    found = run_cli(tmp_path, "files", raw, "cli.logs", tmp_path / "ledger", "--max-files", 2, "--archive", tmp_path / "done")
    assert found == {"batches": 2, "files": 3, "rows_written": 3, "rows_quarantined": 3}
    assert not list(raw.iterdir())
