"""Checkpoints: published in two phases, kept by number, resumed from the pointer."""

import pytest

from groundlane.config import RunSettings
from groundlane.sources import checkpoints, shared

SETTINGS = RunSettings("/d", "Qwen3-VL-8B-Instruct", "/o", 4, 8, 117, 1, 1e-4, 25, 50, 14_000_000, use_peft=True, restore_checkpoint=True)


def publish(spark, folder, step, adapter=True, keep=None):
    state = checkpoints.trainer_state(spark, SETTINGS, step, step // 8, 1 / step)
    factors = spark.createDataFrame([("layer", 0, 0, float(step))], "layer string, k int, j int, v double") if adapter else None
    checkpoints.publish(folder, step, state, factors, keep)


def step_of(spark, folder):
    found = checkpoints.latest(spark, folder)
    return found and (found.step, found.state.first()["global_step"], found.adapter and found.adapter.first()["v"])


def test_a_crash_between_the_phases_leaves_the_old_checkpoint(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/checkpoints"
    assert checkpoints.latest(spark, folder) is None
    assert checkpoints.resumed(spark, folder, SETTINGS)["global_step"] == 0
    publish(spark, folder, 400)
    assert step_of(spark, folder) == (400, 400, 400.0)
    with monkeypatch.context() as m:
        m.setattr(checkpoints, "point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            publish(spark, folder, 800)
    assert step_of(spark, folder) == (400, 400, 400.0)
    publish(spark, folder, 800)
    assert step_of(spark, folder) == (800, 800, 800.0)


@pytest.mark.parametrize("call", [0, 1])
def test_a_crash_before_a_rename_leaves_no_half_checkpoint(spark, tmp_path, monkeypatch, call):
    folder, calls, real = f"file://{tmp_path}/checkpoints", [], shared.moved
    publish(spark, folder, 1)

    def fails(*a):
        calls.append(a)
        if len(calls) > call:
            raise OSError("lost")
        real(*a)

    with monkeypatch.context() as m:
        m.setattr(checkpoints, "moved", fails)
        with pytest.raises(OSError, match="lost"):
            publish(spark, folder, 2)
    assert step_of(spark, folder) == (1, 1, 1.0)
    assert any(n.startswith("_draft-") for n in shared.names(spark, folder))
    checkpoints.clean(spark, folder)
    assert not any(n.startswith("_draft-") for n in shared.names(spark, folder)) and step_of(spark, folder)[0] == 1


def test_retention_keeps_the_newest_and_what_the_pointer_names(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    for step in (50, 100, 150):
        publish(spark, folder, step, adapter=step != 100, keep=2)
    assert shared.names(spark, folder) == ["chkp_100.pt", "chkp_150.pt", "chkp_latest", "peft_chkp_150"]
    checkpoints.point(spark, folder, 100, False)
    assert checkpoints.clean(spark, folder, keep=1) == [] and step_of(spark, folder) == (100, 100, None)
    shared.removed(spark, f"{folder}/chkp_latest")
    assert step_of(spark, folder)[0] == 150


def test_resuming_checks_the_settings(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    publish(spark, folder, 400)
    assert checkpoints.resumed(spark, folder, SETTINGS) == {"global_step": 400, "virtual_batch_counter": 50, "best_val_loss": 1 / 400}
    assert checkpoints.resumed(spark, folder, RunSettings(**{**SETTINGS.__dict__, "restore_checkpoint": False}))["global_step"] == 0
    for other in ({"lora_r": 8}, {"use_peft": False}, {"lora_target_modules": ("q_proj",)}):
        with pytest.raises(ValueError, match="other settings"):
            checkpoints.resumed(spark, folder, RunSettings(**{**SETTINGS.__dict__, **other}))
    shared.removed(spark, f"{folder}/chkp_400.pt")
    with pytest.raises(FileNotFoundError):
        checkpoints.latest(spark, folder)
