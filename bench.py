"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores, BENCH_QUERIES a comma list (or ``all``).
"""

import json
import os
import sys
import time

HEADLINE = [
    "q_dice", "q_leaderboard", "q_object_f1", "q_boundary_f1", "q_count_compare", "q_components_26", "q_remove_small",
    "q_otsu_mask", "q_sauvola", "q_percentile_mask", "q_gaussian", "q_opening", "q_fill_holes", "q_organoid", "q_highpass",
    "q_phase_congruency", "q_stitch_mean", "q_tile_extract", "q_predict_demo", "q_resample_linear", "q_norm_volume",
    "q_percentile_window", "q_chunk_roundtrip", "q_random_crop", "q_group_split", "q_pair_inner", "q_prompt_fold",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from voxlake.plans.registry import all_queries
    from voxlake.session import build_session

    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    every = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(every) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    # Start the JVM's compiler and the Python workers on the smallest data; not timed.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("q_leaderboard", "q_components_26", "q_gaussian"):
        every[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
