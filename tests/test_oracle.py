"""Every query with an oracle equals its DuckDB SQL on sf0.001 (run in a
subprocess: DuckDB and a live Spark JVM are kept in separate processes)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_all_queries_match_oracle():
    env = dict(os.environ, ORACLE_ONLY="1")
    p = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "check_oracle.py"), "/root/testdata/sf0.001"],
                       capture_output=True, text=True, env=env, timeout=1500)
    out = p.stdout
    assert "0 failing" in out, out[-4000:]
