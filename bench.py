"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`queries` has the best of three runs of each, with all result rows written to a no-op sink; `event_dedupe`, whose
result grows with the square of a day's events, runs over the sf0.01 tables beside them.  `per_op` restates
the search and the store as an in-process store would quote them, over `rows` normal vectors of 384
dimensions: nanoseconds per scored query-row pair (a thousand queries in a batch), per record appended, and
per record opened; `single_search_s` is one query, and `job_s` what a Spark job costs that does nothing."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "vec_topk vec_topk_batch vec_norm vec_partition_merge vec_guard store_get store_recover block_index doc_chunks tf_vocab tf_topk "
    "file_events file_diff secret_scan redact html_text mail_prefilter candidate_validate event_overlap event_dedupe cache_upsert burst_detect retrieval_accuracy"
).split()
SMALLER = {"event_dedupe": "sf0.01"}
ROWS, QUERIES_ASKED, DIMS = 100_000, 1_000, 384


def vectors(spark, path: str):  # noqa: ANN001, ANN201
    """ROWS seeded normal vectors, stored."""
    import numpy as np
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            ids = b.column("id").to_numpy()
            v = np.random.default_rng(int(ids[0])).standard_normal((len(ids), DIMS)).astype(np.float32)
            yield pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(np.arange(0, v.size + 1, DIMS, dtype=np.int32), v.ravel())], names=["vec_id", "embedding"])

    spark.range(0, ROWS, 1, 8).mapInArrow(run, "vec_id long, embedding array<float>").write.parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    from cairn.operators import search, store
    from cairn.plans import QUERIES
    from cairn.session import local_session

    spark = local_session(CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(run) -> float:  # noqa: ANN001
        began = time.perf_counter()
        run()
        return time.perf_counter() - began

    save = lambda df: df.write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        where = str(Path(SF_DIR).parent / SMALLER[name]) if name in SMALLER else SF_DIR
        times[name] = round(min(timed(lambda: save(QUERIES[name](spark, where))) for _ in range(3)), 4)  # noqa: B023
    folder = tempfile.mkdtemp(prefix="bench-")
    rows = vectors(spark, f"{folder}/rows")
    asked = rows.where(f"vec_id % {ROWS // QUERIES_ASKED} = 0")
    batch = min(timed(lambda: save(search.top_k_batch(asked, rows))) for _ in range(2))
    v = [float(x) for x in rows.first()["embedding"]]
    single = min(timed(lambda: search.top_k(rows, v).collect()) for _ in range(3))
    append = min(timed(lambda: store.append(spark, f"{folder}/store", rows.drop("vec_id"))) for _ in range(2))
    opened = min(timed(lambda: save(spark.read.parquet(f"{folder}/rows"))) for _ in range(2))
    idle = min(timed(lambda: spark.range(1).collect()) for _ in range(3))
    shutil.rmtree(folder)
    per_op = {"append_ns_per_record": append / ROWS * 1e9, "open_ns_per_record": opened / ROWS * 1e9, "batch_search_ns_per_pair": batch / (ROWS * QUERIES_ASKED) * 1e9, "single_search_s": single, "job_s": idle, "records": ROWS, "dims": DIMS}
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(SF_DIR).name.removeprefix("sf"), "per_op": {a: round(b, 4) for a, b in per_op.items()}}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    main()
