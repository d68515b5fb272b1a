"""The queries of this engine and their SQL, by name."""

from __future__ import annotations

from . import queries as q
from .sql import SQL

QUERIES: dict = {
    f.__name__: f
    for f in (
        q.flagship_window_totals, q.manifest_parse, q.eval_spec_parse, q.duration_seconds, q.frame_budget, q.duration_index_lastwins, q.duration_lookup,
        q.content_md5, q.token_encode, q.token_decode, q.token_label, q.vocabulary, q.xy_shift, q.block_path, q.path_suffix,
        q.split_union, q.split_fallback, q.skip_reasons, q.kept_skipped, q.max_files_limit, q.cache_decision, q.cache_pending, q.block_store_roundtrip,
        q.block_counts, q.global_index, q.index_lookup, q.get_block, q.seeded_shuffle, q.numbered_blocks, q.sample_exact_n, q.sample_with_replacement, q.batches, q.fan_out,
        q.sample_passes, q.sampled_blocks, q.sampled_batches, q.split_index, q.split_loaders, q.split_batches,
        q.build_counts, q.build_blocks, q.build_items, q.build_counts_again, q.npy_roundtrip, q.scan_manifest,
        q.choose_token, q.narrow_bfloat16, q.early_stop_threshold, q.epoch_scores, q.gate_run, q.predict_run, q.corpus_counts, q.corpus_blocks,
        q.prompt_select, q.prompt_slice, q.concat_stream, q.greedy_accuracy, q.gt_pred_compare, q.compare_csv, q.truth_fallback, q.top_k, q.macro_accuracy, q.argmax_accuracy, q.cross_entropy,
        q.masked_mean, q.subset_metrics, q.micro_macro, q.micro_rollup, q.best_epoch, q.early_stop, q.gate_report, q.gate_json,
        q.forward_fill, q.latest_with_fallback, q.prune_and_narrow,
    )
} | {
    "windows": q._windows(q.SEQ), "windows_overlap": q._windows(q.SEQ // 2), "windows_gap": q._windows(2 * q.SEQ),
    "change_log": q.change_log_q,
}

__all__ = ["QUERIES", "SQL"]
