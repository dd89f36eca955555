"""The working folder: a session of its own without any preset folder, and written tables that can be dropped."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

QUICK_START = """
import datetime as dt, math, os, sys
from hourloom.session import build_session, drop_written, work_dir
from hourloom.sources.meter_text import read_meter_text
from hourloom.plans import training
from hourloom.operators import forecast
from hourloom.config import ForestConfig, KMeansConfig, RunConfig

folder = sys.argv[1]
spark = build_session("local[2]", shuffle_partitions=2, memory="2g")
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.checkpoint.dir", None) is None
hourly, daily, profiles = training.prepare(read_meter_text(spark, folder + "/*.txt"))
run = training.train_run(daily, profiles, RunConfig(forest=ForestConfig(trees=2, depth=3), kmeans=KMeansConfig(restarts=1), clusters=2))
assert training.run_report(run).count() > 0
states = training.states_for(run.clean, run.daily)
trees = forecast.forest_arrays(spark, run.model)
assert forecast.forecast_ahead(states, trees, run.inputs, days=3).count() == 3
assert os.listdir(work_dir(spark)) and drop_written(spark) > 0 and not os.listdir(work_dir(spark))
print("quick start done")
"""


def meter_file(folder: Path) -> None:
    """Sixty days of half-hour readings in the source's layout."""
    import datetime as dt
    import math

    lines = ["Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3"]
    for i in range(60 * 48):
        at = dt.datetime(2007, 1, 1) + dt.timedelta(minutes=30 * i)
        level = 1.5 + math.sin(i / 7) + (i // 48 % 7) / 5
        lines.append(f"{at.day}/{at.month}/{at.year};{at:%H:%M:%S};{level:.3f};0.1;240.0;{level * 4:.2f};0;1;2")
    (folder / "meter.txt").write_text("\n".join(lines) + "\n")


def test_quick_start_runs_without_a_preset_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    meter_file(tmp_path)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(ROOT), "TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", QUICK_START, str(tmp_path)], env=env, capture_output=True, text=True, timeout=600)
    assert "quick start done" in run.stdout, run.stderr[-3000:]
