import pyarrow as pa

from hourloom.llm import arrow


def task(keeps, leaves=None):
    def run(batches):
        if leaves:
            arrow.worker_memory()[leaves] = [0] * 10
        yield from batches

    return list(arrow.lean(run, keeps)(iter([pa.record_batch({"a": [1]}), pa.record_batch({"a": [2]})])))


def test_a_task_drops_what_other_operators_left_and_keeps_its_own():
    held = arrow.worker_memory()
    assert [b.num_rows for b in task("held tokenizer", "held tokenizer x")] == [1, 1]
    task("held tokenizer")
    assert "held tokenizer x" in held
    task("")
    assert "held tokenizer x" not in held and "__name__" in held


def test_a_task_that_fails_still_says_why():
    def run(batches):
        yield next(batches)
        raise ValueError("broken row")

    made = arrow.lean(run)(iter([pa.record_batch({"a": [1]})]))
    assert next(made).num_rows == 1
    try:
        next(made)
    except ValueError as e:
        assert str(e) == "broken row"
    else:
        raise AssertionError
