"""User extensions: parsers by content type, pipelines by priority, finalizers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.paragraphs import route_content_type

Handler = Callable[[DataFrame, dict], DataFrame]
Step = Callable[[DataFrame], DataFrame]
Finalizer = Callable[[DataFrame, Any, Mapping[str, str]], DataFrame]


class ParserRegistry:
    """Content types and the functions that turn responses of that type into rows.

    Types are tried in the order of their registration. ``accepts`` names the pipelines that a
    parser's rows fit; an empty list accepts all.
    """

    def __init__(self) -> None:
        self.handlers: dict[str, Handler] = {}
        self.accepts: dict[str, tuple[str, ...]] = {}

    def register(self, content_type: str, handler: Handler, accepts: Sequence[str] = ()) -> None:
        self.handlers[content_type.lower()] = handler
        self.accepts[content_type.lower()] = tuple(accepts)

    def accepted(self, content_type: str, pipeline: str) -> bool:
        names = self.accepts[content_type.lower()]
        return not names or pipeline in names

    def parse(self, responses: DataFrame, data: dict | None = None) -> DataFrame:
        """Rows of all handlers; responses that no handler takes yield nothing."""
        if not self.handlers:
            raise ValueError("no parser is registered")
        routed = route_content_type(responses, list(self.handlers))
        parts = [
            handler(routed.filter(F.col("handler") == content_type).drop("handler"), dict(data or {}))
            for content_type, handler in self.handlers.items()
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_pipelines(rows: DataFrame, pipelines: Mapping[str, int], steps: Mapping[str, Step]) -> DataFrame:
    """Apply the named steps in ascending priority, each to what the one before returned."""
    ordered = sorted(pipelines.items(), key=lambda item: item[1])
    return reduce(lambda df, item: df.transform(steps[item[0]]), ordered, rows)


def run_finalizers(
    rows: DataFrame,
    spec: Any,
    finalizers: Mapping[str, Mapping[str, str]],
    functions: Mapping[str, Finalizer],
) -> dict[str, DataFrame]:
    """Give the parsed table, the specification and its own data to each known finalizer."""
    return {
        name: functions[name](rows, spec, data)
        for name, data in finalizers.items()
        if name in functions
    }
