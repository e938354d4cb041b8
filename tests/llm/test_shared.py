"""Workers keep tables of encoded pieces while operators use them and let them go in other operators' tasks."""

import pyarrow as pa

from fathomline.llm import shared, tokens
from fathomline.llm.queries import tokenizer_file


def test_workers_let_go(spark):
    content_at = spark.sparkContext.broadcast(tokens.load(tokenizer_file()))

    def use(batches):
        tokens.encoder(content_at.value)
        yield from look(batches)

    def look(batches):
        n = len(tokens._LOADED)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows)], ["n"])

    rows = spark.range(4).coalesce(1)
    counted = lambda run, keeps: {r.n for r in rows.mapInArrow(shared.released(run, keeps), "n bigint").collect()}
    assert counted(use, True) == {1}
    assert counted(use, False) == {1}  # made anew
    assert counted(look, False) == {0}
