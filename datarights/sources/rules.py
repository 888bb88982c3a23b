"""Rule tables: five small YAML files, validated once, used as literals or DataFrames."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

RULES_DIR = Path(__file__).resolve().parent.parent / "rules"
FILES = ("scan", "stores", "recipients", "entrypoints", "patterns")
RULE_ID = re.compile(r"^(R\d{1,2}[ab]?|CG-\d{1,2}|SE\d{1,2}|[a-z_]+)$")


class RuleError(ValueError):
    """A rule file that is not in the shape the jobs rely on."""


class Rules:
    """The rule data by table name: `words`, `rows` or `map`, whichever the table carries."""

    def __init__(self, tables: dict[str, dict], digest: str) -> None:
        self.tables, self.digest = tables, digest

    def words(self, name: str) -> list[str]:
        return list(self.tables[name]["words"])

    def rows(self, name: str) -> list[list]:
        return [list(r) for r in self.tables[name]["rows"]]

    def map(self, name: str) -> dict:
        return dict(self.tables[name]["map"])

    def extended(self, name: str, extra: list) -> "Rules":
        """User rows appended to one table; the files themselves stay as they are."""
        key = "words" if "words" in self.tables[name] else "rows"
        block = {**self.tables[name], key: self.tables[name][key] + list(extra)}
        return Rules({**self.tables, name: block}, self.digest)


def _validate(path: Path, doc: object) -> dict[str, dict]:
    if not isinstance(doc, dict) or doc.get("version") != 1:
        raise RuleError(f"{path.name}: version must be 1")
    tables = doc.get("tables")
    if not isinstance(tables, dict) or not tables:
        raise RuleError(f"{path.name}: missing section tables")
    for name, block in tables.items():
        if not isinstance(block, dict) or not RULE_ID.match(str(block.get("rule", ""))):
            raise RuleError(f"{path.name} {name}: missing or malformed rule id")
        if len([k for k in ("words", "rows", "map") if k in block]) != 1:
            raise RuleError(f"{path.name} {name}: needs exactly one of words, rows, map")
    return tables


@lru_cache(maxsize=8)
def rules(directory: str | None = None) -> Rules:
    base = Path(directory) if directory else RULES_DIR
    tables: dict[str, dict] = {}
    digest = hashlib.sha256()
    for name in FILES:
        path = base / f"{name}.yaml"
        raw = path.read_bytes()
        digest.update(path.name.encode())
        digest.update(raw)
        tables.update(_validate(path, yaml.safe_load(raw)))
    return Rules(tables, digest.hexdigest())


def load_rules(spark: SparkSession, directory: str | None = None) -> dict[str, DataFrame]:
    """Every word list as a DataFrame `(ord, word)`, keyed by table name."""
    found = rules(directory)
    return {
        name: spark.createDataFrame([(i, str(w)) for i, w in enumerate(block["words"])],
                                    "ord int, word string")
        for name, block in found.tables.items() if "words" in block
    }
