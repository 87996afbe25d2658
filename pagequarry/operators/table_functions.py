"""The page's relations as table functions of SQL.

`register` makes each relation of `parsed` a function page_<relation>,
so that SQL can write

    SELECT p.page_id, h.text FROM pages p, LATERAL page_heading(p.html) h
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dom, parsed


def _function(name: str) -> type:
    relation = parsed.RELATIONS[name].of_tree

    class Reader:
        def eval(self, html: str):
            for pos, row in enumerate(relation(dom.parse(html)) if html else []):
                yield (pos, *row)

    return Reader


def register(spark: SparkSession) -> list[str]:
    """Registers the functions with a session; gives their names. Each returns pos and the relation's fields."""
    for name, relation in parsed.RELATIONS.items():
        spark.udtf.register(f"page_{name}", F.udtf(_function(name), returnType=f"pos int, {relation.schema}", useArrow=True))
    return [f"page_{n}" for n in parsed.RELATIONS]
