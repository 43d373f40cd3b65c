"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from functools import wraps

from pagelore.plans.inputs import SQL as INPUTS
from pagelore.runtime import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, inputs: str = "", name: str | None = None):
    """Registers f(spark, sf_dir) under its name; ``inputs`` names the derived relations that sql reads."""

    def add(f):
        @wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql:
            with_ = [INPUTS[i] for i in inputs.split()]
            body = sql.strip()
            if with_:
                recursive = body.upper().startswith("WITH RECURSIVE ")
                body = body[15:] if recursive else body
                rest = body[5:] if body[:5].upper() == "WITH " else body
                own = recursive or body[:5].upper() == "WITH "
                body = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(with_) + (",\n" if own else "\n") + rest
            ORACLES[key] = body
        return f

    return add
