"""A graph that grows as model outputs arrive: every micro-batch is parsed, merged and committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..sources.shared import TableStore, written


def merge_outputs(outputs: DataFrame, store: TableStore, batch: int, rules: state.Rules | None = None) -> bool:
    """Outputs (``chunk_id, doc_id, file_path, output, time``) of one batch into the stored graph; False if it is there already.

    Chunks and outputs are kept in the same commit, so that documents can be deleted later. A null output has no records.
    """
    if batch <= store.last_batch():
        return False
    outputs = written(outputs.select("chunk_id", "doc_id", "file_path", "output", "time"), "outputs")
    chunks, cache = outputs.select("chunk_id", "doc_id", "file_path").dropDuplicates(["chunk_id"]), outputs.select("chunk_id", "output", "time").dropDuplicates(["chunk_id", "time"])
    graph = {n: store.read(n) for n in state.SCHEMAS}
    changes = state.merge_batch(graph, *state.cached_records(cache, chunks), batch, rules)
    return store.commit(batch, changes | {"chunks": written(chunks, "chunks"), "cache": written(cache, "cache")}, new=state.TRACKING)


def merge_stream(stream: DataFrame, store: TableStore, checkpoint: str, rules: state.Rules | None = None) -> StreamingQuery:
    """Merges a stream of outputs batch by batch; a batch that runs again after a failure changes nothing twice."""
    return stream.writeStream.foreachBatch(lambda batch, i: merge_outputs(batch, store, i, rules) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
