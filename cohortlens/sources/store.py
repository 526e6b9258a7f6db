"""Answers and conversations as JSON files in one folder."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TURNS = 20


class Store:
    """Each answer is a file; a conversation is the list of its turns.  Ids are plain names."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        for part in ("answers", "conversations"):
            (self.folder / part).mkdir(parents=True, exist_ok=True)

    def _path(self, part: str, name: str) -> Path:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name):
            raise ValueError(f"no id: {name!r}")
        return self.folder / part / f"{name}.json"

    def save_answer(self, answer_id: str, answer: dict[str, Any]) -> None:
        self._path("answers", answer_id).write_text(json.dumps(answer))

    def answer(self, answer_id: str) -> dict[str, Any] | None:
        path = self._path("answers", answer_id)
        return json.loads(path.read_text()) if path.exists() else None

    def turns(self, conversation_id: str) -> list[dict[str, Any]]:
        path = self._path("conversations", conversation_id)
        return json.loads(path.read_text()) if path.exists() else []

    def add_turn(self, conversation_id: str, turn: dict[str, Any]) -> None:
        self._path("conversations", conversation_id).write_text(json.dumps([*self.turns(conversation_id), turn]))

    def gate_sets(self, conversation_id: str) -> tuple[set[str], set[str]]:
        """Ids retrieved, and entities seen, over all turns so far."""
        turns = self.turns(conversation_id)
        return {i for t in turns for i in t.get("retrieved", [])}, {e for t in turns for e in t.get("seen_entities", [])}

    def digest(self, conversation_id: str, most: int = MOST_TURNS) -> str:
        """The last turns, one line each, for a prompt."""
        return "\n".join(f"Q: {t.get('question', '')} [{t.get('answer_id', '')}]" for t in self.turns(conversation_id)[-most:])

    def all_turns(self, spark: SparkSession) -> DataFrame:
        """Every turn of every conversation: conversation, turn, question, retrieved, seen_entities."""
        raw = spark.read.format("binaryFile").load(f"{self.folder}/conversations")
        kind = "array<struct<question: string, answer_id: string, retrieved: array<string>, seen_entities: array<string>>>"
        rows = raw.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("conversation"), F.from_json(F.decode("content", "UTF-8"), kind).alias("turns"))
        return rows.select("conversation", F.posexplode("turns").alias("turn", "t")).select("conversation", "turn", "t.*")
