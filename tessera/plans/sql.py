"""The queries in SQL, as an independent statement of what they return."""

from __future__ import annotations

_TOK = r"""tok AS (SELECT doc_id, source, lang, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: length(w) % 256 + 1) AS ids FROM documents)"""


def _win(stride: int, seq: int = 16) -> str:
    """Windows by their starts, not by the count formula: one more while the last has not reached the end."""
    w = seq + 1
    return f"""{_TOK},
st AS (SELECT doc_id, source, lang, ids, unnest(range(0, greatest(1, len(ids) - 1), {stride})) AS s FROM tok WHERE len(ids) >= 2),
win AS (SELECT doc_id, source, lang, s // {stride} AS block_idx, list_resize(ids[s + 1:s + {w}], {w}, 0) AS block FROM st WHERE s = 0 OR s - {stride} + {w} < len(ids))"""


_CNT = "cnt AS (SELECT doc_id AS file_ord, count(*) AS n FROM win GROUP BY doc_id)"
_IDX = f"{_CNT}, idx AS (SELECT file_ord, n, (sum(n) OVER (ORDER BY file_ord) - n)::BIGINT AS cum FROM cnt)"
_DUR = """dur AS (SELECT o_orderkey, o_orderkey % 97 AS m, o_custkey % 60 AS s, o_orderkey % 4 AS k, o_orderkey % 1000 AS ms, o_custkey % 3 AS h FROM orders),
sec AS (SELECT o_orderkey, CASE k WHEN 0 THEN (m * 60 + s)::DOUBLE WHEN 1 THEN (m * 60 + s)::DOUBLE + ms::DOUBLE / 1000::DOUBLE WHEN 2 THEN (h * 3600 + m * 60 + s)::DOUBLE ELSE s::DOUBLE END AS seconds FROM dur)"""
_LAST = """lines AS (SELECT doc_id, md5(text) AS md5, CASE WHEN doc_id % 13 = 0 THEN [] ELSE [(doc_id % 7) || ':' || lpad((doc_id % 60)::VARCHAR, 2, '0'), '0:30'] END AS times FROM documents WHERE doc_id % 11 <> 0),
last AS (SELECT md5, arg_max(times, doc_id) AS times FROM lines GROUP BY md5)"""
_TP = r"""gt AS (SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: length(w) % 256 + 1) AS gt FROM benchmark),
tp AS (SELECT item_id, gt, list_concat(list_transform(range(1, len(gt) + 1), lambda i: CASE WHEN (gt[i] + i - 1) % 3 = 0 THEN gt[i] + 1 ELSE gt[i] END), [1, 2]) AS pred FROM gt)"""
_PAIRS = "pairs AS (SELECT item_id, i - 1 AS i, gt[i] AS gt, pred[i] AS pred FROM (SELECT *, unnest(range(1, len(pred) + 1)) AS i FROM tp))"
_SC = """sc AS (SELECT l_returnflag AS split, l_orderkey % 50 AS batch, trunc(l_quantity)::BIGINT % 5 AS y, l_linenumber % 5 AS pred, round(l_discount * 100) AS loss FROM lineitem),
part_ AS (SELECT split, batch, sum(CASE WHEN y <> 0 THEN loss ELSE 0 END) AS loss_sum, count(*) FILTER (y <> 0 AND y = pred) AS correct_sum, greatest(count(*) FILTER (y <> 0), 1) AS tok_sum FROM sc GROUP BY ALL),
sub AS (SELECT split, sum(loss_sum) AS loss_sum, sum(correct_sum)::BIGINT AS correct_sum, sum(tok_sum)::BIGINT AS tok_sum FROM part_ GROUP BY split)"""
_HIST = f"{_SC}, hist AS (SELECT split, batch AS epoch, sum(loss) AS val_loss FROM sc GROUP BY ALL)"
_ST = "st AS (SELECT user_id % 8 AS chip, event_id AS frame, event_type AS reg, floor(value)::BIGINT % 3 AS val FROM events)"
_REASON = f"""{_TOK}, q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
reason AS (SELECT doc_id, source AS split, CASE WHEN quality IS NULL THEN 'no source' WHEN quality <> 1 THEN 'no budget' WHEN len(ids) < 2 THEN 'too short' END AS skip_reason FROM tok LEFT JOIN q USING (doc_id))"""
_LABEL = """CASE WHEN id = 0 THEN 'PAD' WHEN id - 1 BETWEEN 0 AND 3 THEN 'BYTE_' || (id - 1) WHEN id - 1 BETWEEN 4 AND 6 THEN 'CMD_' || (id - 5)
  WHEN id - 1 BETWEEN 7 AND 15 THEN 'NOTE_' || CASE WHEN id - 1 >= 11 THEN '+' ELSE '' END || (id - 12) WHEN id - 1 = 16 THEN 'END' ELSE 'RESERVED_' || (id - 1) END"""
_STORED = f"""{_win(16)}, {_IDX}, t AS (SELECT sum(n)::BIGINT AS n FROM idx),
g AS (SELECT cum + block_idx AS global_idx, block, t.n AS n FROM win JOIN idx ON doc_id = file_ord, t),
stored AS (SELECT *, (row_number() OVER (ORDER BY md5(global_idx || '|7'), global_idx) - 1 - ('0x' || md5('7|3|0')[1:8])::BIGINT % n + n) % n AS draw FROM g)"""
_SPL = f"""{_win(16)}, {_CNT}, men AS (SELECT unnest(['eval-fr', 'train', 'eval-de', 'none', 'eval-fr', 'eval-de']) AS split, unnest(['fr', 'en', 'de', 'xx', 'es', 'de']) AS lang, unnest(range(0, 6))::INT AS mention),
spl AS (SELECT split, mention, doc_id AS line_no, n, (sum(n) OVER (PARTITION BY split ORDER BY mention, doc_id) - n)::BIGINT AS cum FROM men JOIN documents USING (lang) JOIN cnt ON doc_id = file_ord)"""
_BUILT = f"""{_TOK}, {_LAST}, men AS (SELECT unnest(['train', 'eval-de', 'eval-x', 'eval-x']) AS split, unnest(['en', 'de', 'fr', 'es']) AS lang, unnest([0, 1, 2, 2]) AS split_ord),
b AS (SELECT split, split_ord, d.doc_id, d.source || '/' || d.doc_id || '.sid' AS sid, (d.doc_id % 4)::INT AS subtune, d.text, t.ids, CASE WHEN d.doc_id % 4 >= 1 THEN times[d.doc_id % 4] END AS t
      FROM documents d JOIN men USING (lang) JOIN tok t ON t.doc_id = d.doc_id LEFT JOIN last ON md5(d.text) = last.md5),
c AS (SELECT *, ids[1:trunc(985248::DOUBLE * (split_part(t, ':', 1)::BIGINT * 60 + split_part(t, ':', 2)::BIGINT)::DOUBLE)::BIGINT // 19656] AS cut FROM b),
r AS (SELECT * EXCLUDE (ids, cut), cut AS ids, CASE WHEN doc_id % 17 = 0 THEN 'no source' WHEN t IS NULL THEN 'no budget' WHEN contains(text, '$') THEN 'codec' WHEN len(cut) < 2 THEN 'too short' END AS reason FROM c),
built AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0 WHEN len(ids) <= 17 THEN 1 ELSE 1 + (len(ids) - 17 + 15) // 16 END AS n_blocks FROM r)"""


def _fold(key: str, value: str, delta: float, patience: int, threshold: float | None) -> str:
    """h (key, i, value) read row by row: f (key, i, best, wait, reason, ran)."""
    low = f"{{v}} < {threshold}" if threshold is not None else "false"
    first, later = low.format(v=value), low.format(v=f"h.{value}")
    return f"""f AS (
  SELECT {key}, i, CASE WHEN NOT {first} THEN {value} END AS best, 0 AS wait, CASE WHEN {first} THEN 'threshold' END AS reason, true AS ran FROM h WHERE i = 1
  UNION ALL
  SELECT {key}, n, CASE WHEN go AND NOT low AND gain THEN v ELSE best END, CASE WHEN NOT go OR low THEN wait WHEN gain THEN 0 ELSE wait + 1 END,
         CASE WHEN NOT go THEN NULL WHEN low THEN 'threshold' WHEN NOT gain AND wait + 1 >= {patience} THEN 'patience' END, go
  FROM (SELECT h.{key}, h.i AS n, h.{value} AS v, f.best, f.wait, f.ran AND f.reason IS NULL AS go, {later} AS low, coalesce(h.{value} + {delta} < f.best, true) AS gain FROM f JOIN h ON h.{key} = f.{key} AND h.i = f.i + 1))"""


_MD5 = "md5({} || '|{}')"

SQL: dict[str, str] = {
    "flagship_window_totals": f"WITH {_win(16)} SELECT source, lang, count(*) AS n_blocks, sum(len(list_filter(block[2:], lambda y: y <> 0)))::BIGINT AS n_targets, count(DISTINCT doc_id) AS n_docs FROM win GROUP BY ALL",
    "manifest_parse": r"""
WITH l AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') || ' ' || chr(9) || p_size WHEN 1 THEN '# ' || replace(p_name, ' ', '_') WHEN 2 THEN '  '
  WHEN 3 THEN p_brand || '/x.sid  ' || p_size ELSE replace(p_name, ' ', '_') || '  ' || p_size || ' # ' || p_type END AS line FROM part),
b AS (SELECT p_partkey, regexp_replace(split_part(line, '#', 1), '^\s+|\s+$', '', 'g') AS body FROM l),
p AS (SELECT p_partkey, CASE WHEN contains(body, chr(9)) THEN string_split(body, chr(9)) ELSE regexp_split_to_array(body, '\s+') END AS f FROM b WHERE body <> '')
SELECT p_partkey, f[1] AS relpath, CASE WHEN len(f) > 1 THEN trim(f[2])::INT ELSE 1 END AS subtune FROM p""",
    "eval_spec_parse": """
WITH s AS (SELECT n_nationkey, ' eval-' || n_name || ' = /lists/a=' || n_nationkey || ';;bare ; x=/b.list;' AS spec FROM nation),
p AS (SELECT n_nationkey, i - 1 AS ord, trim(string_split(spec, ';')[i]) AS part FROM (SELECT *, unnest(range(1, len(string_split(spec, ';')) + 1)) AS i FROM s))
SELECT n_nationkey, ord::INT AS ord, trim(split_part(part, '=', 1)) AS name, CASE WHEN contains(part, '=') THEN trim(substr(part, strpos(part, '=') + 1)) ELSE '' END AS path FROM p WHERE part <> ''""",
    "duration_seconds": f"WITH {_DUR} SELECT o_orderkey, seconds FROM sec",
    "frame_budget": f"WITH {_DUR} SELECT o_orderkey, trunc(985248::DOUBLE * seconds)::BIGINT // 19656 AS pal, trunc(1022727::DOUBLE * seconds)::BIGINT // 17095 AS ntsc FROM sec",
    "duration_index_lastwins": f"WITH {_LAST} SELECT md5, array_to_string(times, ',') AS times FROM last",
    "duration_lookup": f"""WITH {_LAST}, t AS (SELECT d.doc_id, (d.doc_id % 4)::INT AS subtune, CASE WHEN d.doc_id % 4 >= 1 THEN times[d.doc_id % 4] END AS t FROM documents d LEFT JOIN last ON md5(d.text) = last.md5)
SELECT doc_id, subtune, t IS NOT NULL AS found, coalesce(trunc(985248::DOUBLE * (split_part(t, ':', 1)::BIGINT * 60 + split_part(t, ':', 2)::BIGINT)::DOUBLE)::BIGINT // 19656, 0) AS frames FROM t""",
    "content_md5": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "token_encode": f"WITH {_TOK} SELECT doc_id, array_to_string(list_transform(ids, lambda x: x + 1), ',') AS ids FROM tok",
    "token_decode": f"WITH {_TOK} SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(ids, lambda x: (x * 7) % 19 - 1), lambda x: x BETWEEN 1 AND 12), lambda x: x - 1), ',') AS ids FROM tok",
    "token_label": f"WITH {_TOK}, e AS (SELECT unnest(ids)::INT AS id FROM tok) SELECT id, {_LABEL} AS label, count(*) AS n FROM e GROUP BY ALL",
    "vocabulary": f"WITH {_TOK}, v AS (SELECT unnest(range(0, 257)) AS id), e AS (SELECT unnest(ids) AS id FROM tok) SELECT v.id, {_LABEL.replace('id', 'v.id')} AS label, count(e.id) AS n FROM v LEFT JOIN e ON e.id = v.id GROUP BY v.id",
    "xy_shift": f"WITH {_win(16)} SELECT doc_id, block_idx, array_to_string(block[1:16], ',') AS x, array_to_string(block[2:17], ',') AS y FROM win",
    "block_path": """
WITH p AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '.sid' ELSE '' END AS sid FROM pages),
r AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN '/' || sid ELSE sid END AS rel FROM p)
SELECT page_id, CASE WHEN ends_with(sid, '.sid') THEN sid[:-5] ELSE sid END || '.' || page_id % 5 || '.blocks.npy' AS blocks,
       CASE WHEN starts_with(rel, '/') THEN rel ELSE '/root/dir/' || rel END AS resolved FROM r""",
    "path_suffix": r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN regexp_matches(url, '[^/]\.[^./]+$') THEN regexp_replace(url, '(\.[^./]+)$', '.' || page_id % 4 || '\1') ELSE url || '.' || page_id % 4 END AS path FROM pages""",
    "split_union": """
WITH u AS (SELECT 'train' AS split, 0 AS split_ord, doc_id FROM documents WHERE lang IN ('en', 'fr') UNION ALL SELECT 'eval-de', 1, doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT 'eval-de', 1, doc_id FROM documents WHERE lang = 'de')
SELECT split, split_ord, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM u GROUP BY ALL""",
    "split_fallback": """
WITH s AS (SELECT source AS split, min(doc_id) AS split_ord FROM documents GROUP BY source)
SELECT split, split_ord, 0 AS case FROM s WHERE split = 'src3' UNION ALL SELECT 'val', 1000000000, 1 UNION ALL (SELECT split, split_ord, 2 FROM s ORDER BY split_ord, split LIMIT 1)""",
    "skip_reasons": f"WITH {_REASON} SELECT doc_id, split, skip_reason FROM reason",
    "kept_skipped": f"WITH {_REASON} SELECT split, count(*) FILTER (skip_reason IS NULL) AS kept, count(*) FILTER (skip_reason IS NOT NULL) AS skipped FROM reason GROUP BY split",
    "max_files_limit": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50",
    "cache_decision": "SELECT doc_id, doc_id % 3 <> 0 AS cached FROM documents",
    "cache_pending": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0",
    "block_store_roundtrip": f"WITH {_win(16)} SELECT source || '/' || doc_id AS sid, block_idx, array_to_string(block, ',') AS block FROM win",
    "block_counts": f"WITH {_win(16)} SELECT doc_id, count(*) AS n FROM win GROUP BY doc_id",
    "global_index": f"WITH {_win(16)}, {_IDX} SELECT file_ord, n, cum FROM idx",
    "index_lookup": f"WITH {_win(16)}, {_IDX}, a AS (SELECT event_id, (event_id * 7919) % (SELECT sum(n)::BIGINT FROM idx) AS i FROM events) SELECT event_id, i AS idx, file_ord, i - cum AS block_idx FROM a JOIN idx ON i >= cum AND i < cum + n",
    "get_block": f"WITH {_win(16)} SELECT doc_id AS file_ord, block_idx, array_to_string(block, ',') AS block FROM win WHERE doc_id = 7 AND block_idx = 1",
    "numbered_blocks": f"WITH {_win(16)}, {_IDX} SELECT cum + block_idx AS global_idx, doc_id AS file_ord, block_idx, array_to_string(block, ',') AS block FROM win JOIN idx ON doc_id = file_ord",
    "seeded_shuffle": f"WITH {_win(16)}, {_CNT}, o AS (SELECT doc_id AS file, coalesce(n, 0) AS n, row_number() OVER (ORDER BY md5(doc_id || '|3'), doc_id) - 1 AS file_ord FROM documents LEFT JOIN cnt ON doc_id = file_ord) SELECT file, n, file_ord, (sum(n) OVER (ORDER BY file_ord) - n)::BIGINT AS cum FROM o WHERE n > 0",
    "sample_exact_n": f"WITH {_win(16)}, {_IDX}, g AS (SELECT cum + block_idx AS global_idx, file_ord, block_idx FROM win JOIN idx ON doc_id = file_ord) SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(md5(global_idx || '|5') || '2'), global_idx) AS r FROM g) WHERE r <= (SELECT trunc(0.05 * count(*)) FROM g)".replace("SELECT * FROM (SELECT *, row", "SELECT global_idx, file_ord, block_idx FROM (SELECT *, row"),
    "sample_with_replacement": f"WITH {_win(16)}, {_IDX}, d AS (SELECT draw, ('0x' || md5(draw || '|9')[1:8])::BIGINT % (SELECT sum(n)::BIGINT FROM idx) AS idx FROM (SELECT unnest(range(0, 500)) AS draw)) SELECT draw, d.idx, file_ord, d.idx - cum AS block_idx FROM d JOIN idx i ON d.idx >= cum AND d.idx < cum + n",
    "batches": f"WITH {_win(16)}, {_IDX}, g AS (SELECT cum + block_idx AS global_idx FROM win JOIN idx ON doc_id = file_ord) SELECT global_idx // 8 AS batch, count(*) AS n, string_agg(global_idx, ',' ORDER BY global_idx) AS members FROM g GROUP BY ALL",
    "fan_out": "SELECT item_id, unnest(range(0, 3))::INT AS p FROM benchmark",
    "prompt_select": f"WITH {_win(16)}, r AS (SELECT source || '/' || doc_id AS path, block_idx, list_filter(block, lambda x: x > 0) AS r FROM win), f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY block_idx) AS k FROM r WHERE len(r) >= 7) SELECT path, array_to_string(r[1:6], ',') AS prompt, array_to_string(r[7:11], ',') AS truth FROM f WHERE k = 1 ORDER BY path LIMIT 8",
    "prompt_slice": f"WITH {_TOK} SELECT doc_id, array_to_string(ids[1:4], ',') AS prompt, 6::BIGINT AS n_generate, array_to_string(ids[1:10], ',') AS compare FROM tok",
    "concat_stream": f"WITH {_TP} SELECT item_id, array_to_string(list_concat(gt[1:3], pred), ',') AS ids FROM tp",
    "greedy_accuracy": f"WITH {_TP}, {_PAIRS} SELECT item_id, round(CASE WHEN count(gt) > 0 THEN count(*) FILTER (gt = pred)::DOUBLE / count(gt) ELSE 0 END, 9) AS acc FROM pairs GROUP BY item_id",
    "gt_pred_compare": f"WITH {_TP}, {_PAIRS} SELECT item_id, i::INT AS i, coalesce(gt::VARCHAR, '') AS gt, pred FROM pairs",
    "compare_csv": f"WITH {_TP}, {_PAIRS} SELECT item_id, i::INT AS i, coalesce(gt::VARCHAR, '') AS gt, pred FROM pairs",
    "truth_fallback": f"WITH {_TP} SELECT item_id, array_to_string(CASE WHEN len(gt) % 4 <> 0 THEN pred ELSE gt END, ',') AS ids FROM tp",
    "top_k": """
WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM e)
SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY k) AS ids, round(exp(max(v) / 0.5) / sum(exp(v / 0.5)), 6) AS p FROM r WHERE k <= 3 GROUP BY vec_id""",
    "macro_accuracy": f"""WITH {_TP}, {_PAIRS}, p AS (SELECT * FROM pairs WHERE gt IS NOT NULL),
c AS (SELECT item_id, gt AS c FROM p UNION SELECT item_id, pred FROM p),
r AS (SELECT c.item_id, c.c, count(p.gt) AS n, count(*) FILTER (p.gt = p.pred) AS hit FROM c LEFT JOIN p ON c.item_id = p.item_id AND c.c = p.gt GROUP BY ALL)
SELECT item_id, round(avg(CASE WHEN n > 0 THEN hit::DOUBLE / n ELSE 0 END), 9) AS macro_accuracy FROM r GROUP BY item_id""",
    "argmax_accuracy": "WITH a AS (SELECT label, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings) SELECT label, count(*) AS n, count(*) FILTER (pred = label) AS correct, sum(pred)::BIGINT AS preds FROM a GROUP BY label",
    "cross_entropy": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label % len(embedding) + 1 AS k FROM embeddings),
l AS (SELECT *, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS lse FROM e)
SELECT vec_id, round(lse - v[k], 6) AS loss, round(0.9 * (lse - v[k]) + 0.1 * (lse - list_avg(v)), 6) AS smoothed FROM l""",
    "masked_mean": f"WITH {_SC} SELECT split, batch, round(sum(CASE WHEN y <> 0 THEN loss ELSE 0 END) / greatest(count(*) FILTER (y <> 0), 1), 9) AS loss FROM sc GROUP BY ALL",
    "subset_metrics": f"WITH {_SC} SELECT *, round(loss_sum / tok_sum, 9) AS loss, round(correct_sum::DOUBLE / tok_sum, 9) AS acc FROM sub",
    "micro_macro": f"WITH {_SC} SELECT round(sum(loss_sum) / sum(tok_sum), 9) AS micro_loss, round(sum(correct_sum)::DOUBLE / sum(tok_sum), 9) AS micro_acc, round(avg(loss_sum / tok_sum), 9) AS macro_loss, round(avg(correct_sum::DOUBLE / tok_sum), 9) AS macro_acc, count(*) AS subsets FROM sub",
    "micro_rollup": f"WITH {_SC} SELECT split, sum(loss_sum) AS loss_sum, sum(correct_sum)::BIGINT AS correct_sum, sum(tok_sum)::BIGINT AS tok_sum FROM part_ GROUP BY ROLLUP (split)",
    "best_epoch": f"WITH {_HIST} SELECT split, epoch, val_loss FROM hist QUALIFY row_number() OVER (PARTITION BY split ORDER BY val_loss, epoch) = 1",
    "early_stop": f"WITH RECURSIVE {_HIST}, h AS (SELECT split, epoch, val_loss, row_number() OVER (PARTITION BY split ORDER BY epoch) AS i FROM hist), {_fold('split', 'val_loss', 1.0, 3, None)} SELECT h.split, h.epoch, h.val_loss, best, wait, reason, coalesce(reason, '') <> '' AS stop, ran FROM f JOIN h USING (split, i)",
    "early_stop_threshold": f"""WITH RECURSIVE h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, ((100 - i) * 4 + o_orderkey % 11)::DOUBLE AS loss FROM orders),
{_fold('o_custkey', 'loss', 6.0, 3, 350.0)} SELECT h.o_custkey, h.o_orderkey, h.loss, best, wait, reason, coalesce(reason, '') <> '' AS stop, ran FROM f JOIN h USING (o_custkey, i)""",
    "epoch_scores": f"""WITH {_SC} SELECT 'all' AS "of", round(sum(loss_sum) / sum(tok_sum), 9) AS val_loss, round(sum(correct_sum) / sum(tok_sum), 9) AS val_acc FROM part_
UNION ALL SELECT 'one', round(avg(loss_sum / tok_sum), 9), round(avg(correct_sum / tok_sum), 9) FROM part_ WHERE split = 'R'""",
    "sample_passes": f"""WITH {_win(16)}, {_IDX}, t AS (SELECT sum(n)::BIGINT AS n FROM idx), g AS (SELECT unnest(range(0, n)) AS i, n FROM t),
o AS (SELECT i, p, n, row_number() OVER (PARTITION BY p ORDER BY md5(md5(i || '|5') || '2' || CASE WHEN p > 0 THEN '|' || p ELSE '' END), i) - 1 + p * n AS draw FROM g, (SELECT unnest(range(0, 3)) AS p))
SELECT draw // 8 AS batch, string_agg(i, ',' ORDER BY draw) AS members FROM o WHERE draw < trunc(2.3::DOUBLE * n) GROUP BY ALL""",
    "sampled_blocks": f"WITH {_STORED} SELECT draw, global_idx, array_to_string(block[1:16], ',') AS x, array_to_string(block[2:17], ',') AS y FROM stored WHERE draw < trunc(0.05::DOUBLE * n)",
    "sampled_batches": f"WITH {_STORED} SELECT draw // 8 AS batch, count(*) AS n, string_agg(array_to_string(block[1:16], ','), ',' ORDER BY draw) AS x, string_agg(array_to_string(block[2:17], ','), ',' ORDER BY draw) AS y FROM stored WHERE draw < trunc(0.05::DOUBLE * n) GROUP BY ALL",
    "split_index": f"WITH {_SPL} SELECT split, mention, line_no, n, cum FROM spl",
    "split_loaders": f"WITH {_SPL} SELECT (row_number() OVER (ORDER BY split <> 'train', min(mention)) - 1)::INT AS loader, split, sum(n)::BIGINT AS n_blocks, (sum(n)::BIGINT + 7) // 8 AS n_batches FROM spl GROUP BY split",
    "split_batches": f"WITH {_SPL}, b AS (SELECT split, cum + block_idx AS i, line_no || ':' || block[1] AS m FROM spl JOIN win ON doc_id = line_no) SELECT split, i // 8 AS batch, count(*) AS n, string_agg(m, ',' ORDER BY i) AS members FROM b GROUP BY ALL",
    "build_counts": f"WITH {_BUILT} SELECT split, min(split_ord)::INT AS split_ord, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS skipped FROM built GROUP BY split",
    "build_counts_again": f"WITH {_BUILT} SELECT split, min(split_ord)::INT AS split_ord, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS skipped FROM built GROUP BY split",
    "corpus_counts": f"WITH {_BUILT} SELECT split, min(split_ord)::INT AS split_ord, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS skipped FROM built GROUP BY split UNION ALL SELECT 'eval-none', 3, 0, 0",
    "corpus_blocks": f"WITH {_BUILT} SELECT split, sid, subtune, s // 16 AS block_idx, array_to_string(list_resize(ids[s + 1:s + 17], 17, 0), ',') AS block FROM (SELECT *, unnest(range(0, n_blocks)) * 16 AS s FROM built)",
    "build_items": f"WITH {_BUILT} SELECT split, sid, CASE WHEN reason IS NULL THEN 'kept' ELSE 'skipped' END AS status, reason, n_blocks, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS build FROM built",
    "build_blocks": f"WITH {_BUILT} SELECT split, sid, subtune, s // 16 AS block_idx, array_to_string(list_resize(ids[s + 1:s + 17], 17, 0), ',') AS block FROM (SELECT *, unnest(range(0, n_blocks)) * 16 AS s FROM built)",
    "gate_run": f"""WITH {_win(16)}, r AS (SELECT source || '/' || doc_id || '.1.blocks.npy' AS path, block_idx, list_filter(block, lambda x: x > 0) AS r FROM win WHERE doc_id % 5 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY block_idx) AS k FROM r WHERE len(r) >= 7), p AS (SELECT path, r[1:6] AS prompt, r[7:11] AS truth FROM f WHERE k = 1 ORDER BY path LIMIT 100),
s AS (SELECT path, truth, list_transform(range(1, len(truth) + 1), lambda i: prompt[6] + i) AS pred, prompt FROM p),
a AS (SELECT path, len(list_filter(range(1, len(truth) + 1), lambda i: truth[i] = pred[i]))::DOUBLE / len(truth) AS acc,
             list_sum(list_transform(list_filter(list_concat(prompt, pred), lambda x: x BETWEEN 1 AND 256), lambda x: x - 1)) % 3 <> 0 AS decodes FROM s)
SELECT avg(acc) >= 0.01 AND avg(decodes::INT) >= 0.5 AS passed, round(avg(acc), 9) AS mean_greedy_acc, round(avg(decodes::INT), 9) AS decode_rate, count(*) AS n_prompts,
       string_agg(path || ':' || round(acc * 1000000)::BIGINT || ':' || decodes, ',' ORDER BY path) AS per_prompt FROM a""",
    "predict_run": f"""WITH {_win(16)}, fo AS (SELECT doc_id, source, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
w AS (SELECT 'src3' AS wanted, 'src3' AS source UNION ALL SELECT 'no such split', arg_min(source, doc_id) FROM documents),
b AS (SELECT wanted, block[1:10] AS c FROM w JOIN fo USING (source) JOIN win ON win.doc_id = fo.doc_id WHERE r = 2 AND block_idx = 0),
s AS (SELECT wanted, c, c[1:4] AS prompt, list_transform(range(1, 7), lambda i: c[4] + i) AS pred FROM b),
d AS (SELECT *, list_concat(prompt, pred) AS ids, len(list_filter(range(1, 7), lambda i: c[4 + i] = pred[i])) / 6 AS acc FROM s),
e AS (SELECT *, list_sum(list_transform(list_filter(ids, lambda x: x BETWEEN 1 AND 256), lambda x: x - 1)) % 3 <> 0 AS decodes FROM d)
SELECT wanted, unnest(range(0, 3))::INT AS p, array_to_string(ids, ',') AS ids, round(acc, 9) AS acc, decodes,
       array_to_string(list_transform(list_filter(CASE WHEN decodes THEN ids ELSE c END, lambda x: x BETWEEN 1 AND 256), lambda x: x - 1), ',') AS program FROM e""",
    "npy_roundtrip": f"WITH {_win(16)} SELECT doc_id, block_idx, array_to_string(block, ',') AS block FROM win WHERE doc_id % 5 <> 0",
    "scan_manifest": f"WITH {_win(16)}, {_CNT} SELECT doc_id, 128 + 34 * n AS size, 128 + 34 * n AS read, true AS same, CASE WHEN n IS NULL THEN 'no file' END AS missing FROM documents LEFT JOIN cnt ON doc_id = file_ord AND doc_id % 5 <> 0",
    "choose_token": """
WITH e AS (SELECT vec_id, step, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS i FROM embeddings, (SELECT unnest([0, 1])::INT AS step)),
g AS (SELECT *, v / 0.8 - ln(-ln((('0x' || md5(vec_id || '|' || step || '|4|' || i)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)) AS s, row_number() OVER (PARTITION BY vec_id, step ORDER BY v DESC, i) AS k FROM e)
SELECT vec_id, step, arg_max(i, s)::INT AS "any", (arg_max(i, s) FILTER (k <= 3))::INT AS of_three FROM g GROUP BY ALL""",
    "narrow_bfloat16": """
WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
x AS (SELECT *, floor(log2(abs(v::DOUBLE)))::INT AS e FROM e),
b AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE ((e + 127) * 128 + round_even(abs(v::DOUBLE) / pow(2, e - 7), 0)::INT - 128) + CASE WHEN v < 0 THEN -32768 ELSE 0 END END AS w FROM x)
SELECT vec_id, string_agg(w, ',' ORDER BY i) AS bits FROM b GROUP BY vec_id""",
    "gate_report": f"""WITH {_TP}, {_PAIRS}, a AS (SELECT item_id, CASE WHEN count(gt) > 0 THEN count(*) FILTER (gt = pred)::DOUBLE / count(gt) ELSE 0 END AS acc FROM pairs GROUP BY item_id),
s AS (SELECT item_id::VARCHAR AS path, acc, len(gt) % 4 <> 0 AS decodes FROM a JOIN tp USING (item_id))
SELECT avg(acc) >= 0.25 AND avg(decodes::INT) >= 0.5 AS passed, round(avg(acc), 9) AS mean_greedy_acc, round(avg(decodes::INT), 9) AS decode_rate, count(*) AS n_prompts, NULL::VARCHAR AS reason,
       string_agg(path || ':' || round(acc * 1000000)::BIGINT || ':' || decodes, ',' ORDER BY path) AS per_prompt FROM s""",
    "gate_json": f"""WITH {_TP}, {_PAIRS}, a AS (SELECT item_id, count(*) FILTER (gt = pred)::DOUBLE / count(gt) AS acc FROM pairs GROUP BY item_id),
s AS (SELECT acc, len(gt) % 4 <> 0 AS decodes FROM a JOIN tp USING (item_id))
SELECT (avg(acc) >= 0.25 AND avg(decodes::INT) >= 0.5)::VARCHAR AS passed, count(*)::VARCHAR AS n_prompts, '0.25' AS min_acc FROM s""",
    "change_log": f"WITH {_ST}, c AS (SELECT *, row_number() OVER w AS k, lag(val) OVER w AS prev FROM st WINDOW w AS (PARTITION BY chip, reg ORDER BY frame)) SELECT chip, frame * 19656 AS clock, reg, val FROM c WHERE k = 1 OR val IS DISTINCT FROM prev",
    "forward_fill": f"WITH {_ST} SELECT chip, frame, reg, val FROM st",
    "latest_with_fallback": """
WITH e AS (SELECT user_id % 16 AS dir, event_type = 'click' AS best, ts, printf('%08d.ckpt', event_id) AS path FROM events)
SELECT dir, path, best FROM e QUALIFY row_number() OVER (PARTITION BY dir ORDER BY best DESC, ts DESC, path DESC) = 1""",
    "prune_and_narrow": "SELECT l_orderkey, l_linenumber, round(l_extendedprice::FLOAT::DOUBLE, 1) AS l_extendedprice, round(l_tax::FLOAT::DOUBLE, 4) AS l_tax FROM lineitem",
} | {n: f"WITH {_win(t)} SELECT doc_id, block_idx, array_to_string(block, ',') AS block FROM win" for n, t in (("windows", 16), ("windows_overlap", 8), ("windows_gap", 32))}
