"""The source of lines: order over cut files, streams of appended lines, usage of messages."""

import io
import json

import pytest

from codeloom.sources import transcripts
from codeloom.telemetry import calls as C


@pytest.mark.parametrize("size", [1, 2, 5, 7, 64, 10_000])
def test_each_line_once_however_cut(size, monkeypatch):
    monkeypatch.setattr(transcripts, "READ", 5)
    data = "a\n\nbb\r\nccc é\n\n\nlast".encode()
    want, at = [], 0
    for line in data.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    got = [x for i in range(0, len(data), size) for x in transcripts.lines(io.BytesIO(data), i, min(i + size, len(data)), False)]
    assert got == want
    assert [x for i in range(0, len(data), size) for x in transcripts.lines(io.BytesIO(data), i, min(i + size, len(data)), True)] == want[:-1]


def records(n):
    for i in range(n):
        role = "assistant" if i % 2 else "user"
        message = {"role": role, "content": f"text {i} é"} | ({"model": "m1", "usage": {"input_tokens": i, "output_tokens": 2 * i}} if i % 2 else {})
        yield json.dumps({"type": role, "sessionId": "s", "message": message}, ensure_ascii=False)


def test_order_and_usage(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(records(3000)))
    (tmp_path / "b.jsonl").write_text('{"type": "queue-operation"}\nnot json\n\n' + "\n".join(records(2)) + "\n")
    (tmp_path / "c.txt").write_text("no\n")
    path = str(tmp_path)
    df = C.load_native(spark, f"{path}/a.jsonl", bytes="1000")
    assert df.rdd.getNumPartitions() > 100
    texts = [r.block.text for r in df.orderBy("msg_idx").collect()]
    assert texts == [f"text {i} é" for i in range(3000)]
    both = C.native_records(spark, path, ending=".jsonl")
    usage = {(r.model, r.input_tokens, r.output_tokens, r.cache_read) for r in C.message_usage(both).collect()}
    assert usage == {("m1", i, 2 * i, None) for i in range(1, 3000, 2)}
    assert C.load_native(spark, f"{path}/b.jsonl").count() == 2
    assert C.native_records(spark, path, ending=".none").count() == 0


def test_stream_gives_each_line_once(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def run():
        rows = spark.readStream.format(transcripts.register(spark)).options(path=str(folder), bytes="16").load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.value for r in spark.read.parquet(out).collect())

    (folder / "a").write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]
    with (folder / "a").open("a") as f:
        f.write("ee\nfour")
    (folder / "b").write_text("new file with a long line\n")
    assert run() == ["new file with a long line", "one", "three", "two"]
    assert run() == ["new file with a long line", "one", "three", "two"]
