"""The model stage: batches of paragraphs through a chat client, with a failing batch retried row by row."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class ChatClient(Protocol):
    def __call__(self, system: str, user: str) -> str: ...


def reverse_words(system: str, user: str) -> str:
    """A client without a model, for tests: every input with its words in reverse order."""
    return json.dumps([{"id": r["id"], "output": " ".join(reversed(r["input"].split()))} for r in json.loads(user)], ensure_ascii=False)


def echo(system: str, user: str) -> str:
    """A client without a model that leaves every input (or draft) as it is."""
    asked = json.loads(user)
    rows = [(r["id"], r["output"]) for r in asked["draft"]] if isinstance(asked, dict) else [(r["id"], r["input"]) for r in asked]
    return json.dumps([{"id": i, "output": t} for i, t in rows], ensure_ascii=False)


def ask(client: ChatClient, system: str, user: list | dict, ids: list[int]) -> dict[int, str]:
    """The client's outputs by id. ValueError unless the reply's first array has a string for each of ids, once, and no others."""
    reply = client(system, json.dumps(user, ensure_ascii=False))
    start = reply.find("[")
    if start < 0:
        raise ValueError("no array")
    out = {}
    for r in json.JSONDecoder().raw_decode(reply[start:])[0]:
        if not isinstance(r, dict) or type(r.get("id")) is not int or not isinstance(r.get("output"), str) or r["id"] in out:
            raise ValueError("a row without id or output, or twice")
        out[r["id"]] = r["output"]
    if sorted(out) != sorted(ids):
        raise ValueError("other ids")
    return out


def translate(batches: DataFrame, connect: Callable[[], ChatClient], system: str, group: list[str]) -> DataFrame:
    """batches: the group columns, id, input. Returns them with output and error. A batch that fails is asked for again row by row, so one
    bad row costs only itself. The caller should write the result before using it twice: calls cost."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        client = connect()
        rows = [{"id": int(i), "input": t} for i, t in zip(pdf["id"], pdf["input"], strict=True)]
        answers, errors = {}, {}
        try:
            answers = ask(client, system, rows, [r["id"] for r in rows])
        except (ValueError, RuntimeError, TypeError) as whole:
            for r in rows:
                try:
                    if len(rows) == 1:
                        raise whole
                    answers |= ask(client, system, [r], [r["id"]])
                except (ValueError, RuntimeError, TypeError) as e:
                    errors[r["id"]] = f"error: {e}"
        return pdf.assign(output=[answers.get(r["id"], "") for r in rows], error=[errors.get(r["id"]) for r in rows])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields)
    return batches.groupBy(*group).applyInPandas(run, f"{kinds}, output string, error string")
