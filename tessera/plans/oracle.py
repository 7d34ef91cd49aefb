"""DuckDB statements equivalent to the registered queries (the correctness gate).

They run over the given tables, registered as views, and rebuild every
fixture in SQL.  Notes on the two engines:

* DuckDB's ``levenshtein`` counts bytes, Spark's counts code points: the
  CER statements first map the 21 non-ASCII letters of ``documents`` to
  spare control characters (fixed values below).
* The WER statements map the words that both texts of a pair have to one ASCII character
  each, where that is enough, and fill the distance table by recursion for the other pairs.
* Seeds are part of the md5 text: ``md5(key || ':' || seed)``.
"""

from __future__ import annotations

from tessera.config import PrepConfig
from tessera.operators.ordering import MODULUS, round_keys

CFG = PrepConfig()
WORD_VOCAB = 2000
SMALL_VOCAB = 500
BPE_VOCAB = 400

#: The pair at place i of a symbol list counts: a run of one symbol is counted from left to right without overlap.
COUNTED = """CASE WHEN {x}[i] <> {x}[i + 1] THEN true
  ELSE (i - list_max(list_filter(range(1, i + 1), lambda j: j = 1 OR {x}[j] <> {x}[j - 1]))) % 2 = 0 END"""

# The non-ASCII letters of the documents table and the control
# characters that stand in for them in the byte-counting edit distance.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
STAND_INS = [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24]


def _map_letters(x: str) -> str:
    return f"translate({x}, '{LETTERS}', {' || '.join(f'chr({i})' for i in STAND_INS)})"


def W(x: str) -> str:
    """Whitespace words of a text."""
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


SPECIALS_VALUES = "(VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2), ('[PAD]', 3), ('[UNK]', 4), ('[SOS]', 5), ('[EOS]', 6)) s(piece, id)"
SPECIALS_LIST = "('<unk>', '<s>', '</s>', '[PAD]', '[UNK]', '[SOS]', '[EOS]')"

CONV_PAIRS = """conv_pairs AS (
  SELECT u.conv_id * 4294967296 + u.turn AS pair_id, u.text AS src_text, a.text AS tgt_text
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

LINE_PAIRS = """doc_lines AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
line_pairs AS (
  SELECT doc_id * 4294967296 + i AS pair_id, lines[i + 1] AS src_text, lines[i + 2] AS tgt_text
  FROM (SELECT doc_id, lines, unnest(range(greatest(len(lines) - 1, 0))) AS i FROM doc_lines))"""

HYP_REF = """hr_lines AS (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
hyp_ref AS (
  SELECT doc_id * 4294967296 + i AS id, lang, ref,
         replace(replace(replace(replace(ref, ' the ', ' '), 'tion', 'toin'), 'ung', 'nug'), 'ción', 'cion') AS hyp
  FROM (SELECT doc_id, lang, unnest(lines) AS ref, unnest(range(len(lines))) AS i FROM hr_lines))"""


def vocab_cte(name: str, source: str, col: str, size: int) -> str:
    """Specials at 0-6, then the most frequent words by (freq desc, word)."""
    return f"""{name}_wc AS (
  SELECT w AS word, count(*) AS freq FROM (SELECT unnest({W(col)}) AS w FROM {source}) GROUP BY w),
{name} AS (
  SELECT piece, CAST(id AS INTEGER) AS id, CAST(NULL AS BIGINT) AS freq, 'special' AS kind FROM {SPECIALS_VALUES}
  UNION ALL
  SELECT word AS piece, CAST(row_number() OVER (ORDER BY freq DESC, word) + 6 AS INTEGER) AS id, freq, 'word' AS kind
  FROM (SELECT * FROM {name}_wc WHERE word NOT IN {SPECIALS_LIST} ORDER BY freq DESC, word LIMIT {size - 7}))"""


def encode_cte(name: str, source: str, key: str, col: str, vocab: str) -> str:
    """Word ids in word order; NULL text gives NULL, empty text []."""
    return f"""{name}_tok AS (
  SELECT {key} AS k, unnest({W(col)}) AS piece, unnest(range(len({W(col)}))) AS pos FROM {source}),
{name}_grp AS (
  SELECT t.k, list(coalesce(v.id, 0) ORDER BY t.pos) AS ids
  FROM {name}_tok t LEFT JOIN {vocab} v ON v.piece = t.piece GROUP BY t.k),
{name} AS (
  SELECT s.{key} AS k, CASE WHEN s.{col} IS NULL THEN NULL ELSE coalesce(g.ids, []) END AS ids
  FROM {source} s LEFT JOIN {name}_grp g ON g.k = s.{key})"""


def enc_cte(pairs_cte: str, pairs: str) -> str:
    return ",\n".join(
    [
        pairs_cte,
        vocab_cte("vs", pairs, "src_text", WORD_VOCAB),
        vocab_cte("vt", pairs, "tgt_text", WORD_VOCAB),
        encode_cte("es", pairs, "pair_id", "src_text", "vs"),
        encode_cte("et", pairs, "pair_id", "tgt_text", "vt"),
        f"""enc AS (
  SELECT p.pair_id, p.src_text, p.tgt_text, es.ids AS src_ids, et.ids AS tgt_ids,
         CAST(len(es.ids) AS INTEGER) AS src_len, CAST(len(et.ids) AS INTEGER) AS tgt_len
  FROM {pairs} p JOIN es ON es.k = p.pair_id JOIN et ON et.k = p.pair_id)""",
        """ex AS (
  SELECT *,
    list_concat([5], src_ids, [6], list_transform(range(128 - src_len - 2), lambda x: 3)) AS encoder_input,
    list_concat([5], tgt_ids, list_transform(range(128 - tgt_len - 1), lambda x: 3)) AS decoder_input,
    list_concat(tgt_ids, [6], list_transform(range(128 - tgt_len - 1), lambda x: 3)) AS label,
    CAST(tgt_len + 1 AS INTEGER) AS decoder_valid_len
  FROM enc WHERE src_len <= 126 AND tgt_len <= 127)""",
    ]
)


CONV_ENC = enc_cte(CONV_PAIRS, "conv_pairs")


def tagged(source: str, seq_len: int = 128) -> str:
    return f"""CASE WHEN src_len IS NULL OR tgt_len IS NULL THEN 'null_text'
       WHEN src_len > {seq_len - 2} AND tgt_len > {seq_len - 1} THEN 'both'
       WHEN src_len > {seq_len - 2} THEN 'src_long'
       WHEN tgt_len > {seq_len - 1} THEN 'tgt_long' END"""


def prepared_cte(pairs_cte: str, pairs: str) -> str:
    """Split (rank over all rows), epoch-0 order in the split, batches; word lengths."""
    head = f"{pairs_cte},\n" if pairs_cte else ""
    return f"""{head}pl AS (
  SELECT pair_id, CAST(len({W('src_text')}) AS INTEGER) AS src_len, CAST(len({W('tgt_text')}) AS INTEGER) AS tgt_len
  FROM {pairs}),
pt AS (SELECT *, {tagged('pl')} AS drop_reason FROM pl),
ps AS (
  SELECT *, drop_reason IS NULL AS kept,
    CASE WHEN row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42'), pair_id) - 1
              < floor(0.9::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split
  FROM pt),
po AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42:0'), pair_id) - 1 AS "order"
  FROM ps),
prepared AS (
  SELECT *, CAST(floor("order" / CASE WHEN split = 'train' THEN 8 ELSE 1 END) AS BIGINT) AS batch_id FROM po)"""


def report_sql(pairs_cte: str, pairs: str) -> str:
    return f"""WITH {prepared_cte(pairs_cte, pairs)}
SELECT split,
  count(*) AS n_rows,
  CAST(sum(CAST(kept AS INTEGER)) AS BIGINT) AS n_kept,
  CAST(sum(CAST(drop_reason = 'src_long' AS INTEGER)) AS BIGINT) AS n_src_long,
  CAST(sum(CAST(drop_reason = 'tgt_long' AS INTEGER)) AS BIGINT) AS n_tgt_long,
  CAST(sum(CAST(drop_reason = 'both' AS INTEGER)) AS BIGINT) AS n_both,
  CAST(sum(CAST(drop_reason = 'null_text' AS INTEGER)) AS BIGINT) AS n_null_text,
  CAST(max(src_len) AS INTEGER) AS max_src_len,
  CAST(max(tgt_len) AS INTEGER) AS max_tgt_len,
  CAST(sum(CASE WHEN kept THEN src_len END) AS BIGINT) AS src_tokens,
  CAST(sum(CASE WHEN kept THEN tgt_len END) AS BIGINT) AS tgt_tokens,
  CAST(sum(CASE WHEN kept THEN tgt_len + 1 END) AS BIGINT) AS label_tokens,
  CAST(max(batch_id) + 1 AS BIGINT) AS n_batches,
  CAST(count(DISTINCT CASE WHEN kept THEN batch_id END) AS BIGINT) AS n_batches_kept
FROM prepared GROUP BY split"""


def ints(x: str) -> str:
    return f"array_to_string({x}, ',')"


def bleu_counts(source: str, hyp: str, ref: str, by: str, tok=W) -> str:
    return f"""bt AS (SELECT id, {by} AS g, {tok(hyp)} AS h, {tok(ref)} AS r FROM {source}),
bn AS (SELECT unnest([1, 2, 3, 4]) AS n),
bg AS (
  SELECT id, g, n, 0 AS side, unnest(list_transform(range(greatest(len(h) - n + 1, 0)), lambda i: array_to_string(h[i + 1:i + n], ' '))) AS gram FROM bt, bn
  UNION ALL
  SELECT id, g, n, 1 AS side, unnest(list_transform(range(greatest(len(r) - n + 1, 0)), lambda i: array_to_string(r[i + 1:i + n], ' '))) AS gram FROM bt, bn),
bp AS (SELECT g, id, n, gram, sum(1 - side) AS hc, sum(side) AS rc FROM bg GROUP BY g, id, n, gram),
bc AS (
  SELECT g,
    CAST(sum(CASE WHEN n = 1 THEN least(hc, rc) END) AS BIGINT) AS c1, CAST(sum(CASE WHEN n = 2 THEN least(hc, rc) END) AS BIGINT) AS c2,
    CAST(sum(CASE WHEN n = 3 THEN least(hc, rc) END) AS BIGINT) AS c3, CAST(sum(CASE WHEN n = 4 THEN least(hc, rc) END) AS BIGINT) AS c4,
    CAST(sum(CASE WHEN n = 1 THEN hc END) AS BIGINT) AS t1, CAST(sum(CASE WHEN n = 2 THEN hc END) AS BIGINT) AS t2,
    CAST(sum(CASE WHEN n = 3 THEN hc END) AS BIGINT) AS t3, CAST(sum(CASE WHEN n = 4 THEN hc END) AS BIGINT) AS t4
  FROM bp GROUP BY g),
bl AS (SELECT g, CAST(sum(len(h)) AS BIGINT) AS hyp_len, CAST(sum(len(r)) AS BIGINT) AS ref_len FROM bt GROUP BY g),
bs AS (
  SELECT bl.g, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3, coalesce(c4, 0) AS c4,
         coalesce(t1, 0) AS t1, coalesce(t2, 0) AS t2, coalesce(t3, 0) AS t3, coalesce(t4, 0) AS t4, hyp_len, ref_len
  FROM bl LEFT JOIN bc ON bc.g = bl.g)"""


def word_edits(source: str) -> str:
    """``we(id, e)``: edits over words of every (id, hyp, ref) of ``source``; WITH RECURSIVE is needed.

    What both texts have in common at either end goes first.  Words of both become one byte each, all others
    one byte a side, where that is enough bytes; other pairs get the distance table, one
    recursion a row of it (``d[j] = j + min over k <= j of (t[k] - k)`` for the cost of insertions).
    """
    def common(x: str, y: str) -> str:
        return f"coalesce(list_position(list_transform(range(least(len(h), len(r))), lambda i: {x} <> {y}), true) - 1, least(len(h), len(r)))"

    return f"""w0 AS (SELECT id, {W('hyp')} AS h, {W('ref')} AS r FROM {source}),
w1 AS (SELECT id, h, r, {common('h[i + 1]', 'r[i + 1]')} AS k FROM w0),
w2 AS (SELECT id, h[k + 1:] AS h, r[k + 1:] AS r FROM w1),
w3 AS (SELECT id, h, r, {common('h[len(h) - i]', 'r[len(r) - i]')} AS k FROM w2),
w4 AS (SELECT id, h[:len(h) - k] AS h, r[:len(r) - k] AS r FROM w3),
w5 AS (SELECT id, h, r, list_distinct(list_intersect(h, r)) AS c FROM w4),
hx AS (SELECT id, unnest(h) AS hw, unnest(range(1, len(h) + 1)) AS i FROM w5 WHERE len(c) > 93),
rx AS (SELECT id, unnest(r) AS rw, unnest(range(1, len(r) + 1)) AS j FROM w5 WHERE len(c) > 93),
dt AS (
  SELECT id, CAST(0 AS BIGINT) AS i, j, rw, j AS d FROM (SELECT id, j, rw FROM rx UNION ALL SELECT id, 0, NULL FROM w5 WHERE len(c) > 93)
  UNION ALL
  SELECT id, i, j, rw, j + min(t - j) OVER (PARTITION BY id ORDER BY j) AS d
  FROM (
    SELECT dt.id, dt.i + 1 AS i, dt.j, dt.rw,
      CASE WHEN dt.j = 0 THEN dt.i + 1 ELSE least(dt.d + 1, lag(dt.d) OVER (PARTITION BY dt.id ORDER BY dt.j) + CAST(hx.hw <> dt.rw AS BIGINT)) END AS t
    FROM dt JOIN hx ON hx.id = dt.id AND hx.i = dt.i + 1)),
we AS (
  SELECT id, levenshtein(array_to_string(list_transform(h, lambda w: coalesce(chr(CAST(32 + list_position(c, w) AS INTEGER)), chr(1))), ''),
    array_to_string(list_transform(r, lambda w: coalesce(chr(CAST(32 + list_position(c, w) AS INTEGER)), chr(2))), '')) AS e
  FROM w5 WHERE len(c) <= 93
  UNION ALL
  SELECT id, d FROM dt SEMI JOIN (SELECT id, len(h) AS i, len(r) AS j FROM w5 WHERE len(c) > 93) z ON z.id = dt.id AND z.i = dt.i AND z.j = dt.j)"""


def metric_scalars(source: str) -> str:
    """M7 over ``source`` (id, step, hyp, ref)."""
    return f"""{word_edits(source)},
{bleu_counts(source, 'hyp', 'ref', 'step')},
er AS (
  SELECT step, sum(levenshtein({_map_letters('hyp')}, {_map_letters('ref')}))::DOUBLE / nullif(sum(length(ref)), 0) AS cer,
    sum(e)::DOUBLE / nullif(sum(len({W('ref')})), 0) AS wer FROM {source} JOIN we USING (id) GROUP BY step),
al AS (SELECT step, cer, wer, {BLEU_EXPR} AS bleu FROM er JOIN bs ON bs.g = er.step)
SELECT 'validation/' || tag AS tag, step, round(CASE tag WHEN 'cer' THEN cer WHEN 'wer' THEN wer ELSE bleu END, 6) AS value
FROM al, (SELECT unnest(['cer', 'wer', 'bleu']) AS tag)"""


BLEU_EXPR = """CASE WHEN c1 = 0 OR c2 = 0 OR c3 = 0 OR c4 = 0 THEN 0.0 ELSE
  (CASE WHEN hyp_len > ref_len THEN 1.0 ELSE exp(1.0 - ref_len::DOUBLE / hyp_len) END)
  * exp((ln(c1::DOUBLE / t1) + ln(c2::DOUBLE / t2) + ln(c3::DOUBLE / t3) + ln(c4::DOUBLE / t4)) / 4.0) END"""


def _sacre_expr() -> str:
    z = []
    acc = "0"
    for n in range(1, 5):
        acc = f"({acc} + CAST(c{n} = 0 AND t{n} > 0 AS INTEGER))"
        z.append(acc)
    logs = []
    for n in range(1, 5):
        p = (f"(CASE WHEN t{n} = 0 THEN 0.0 WHEN c{n} = 0 THEN 100.0 / (pow(2.0, {z[n - 1]}) * t{n}) "
             f"ELSE 100.0 * c{n} / t{n} END)")
        logs.append(f"(CASE WHEN {p} = 0 THEN -9999999999.0 ELSE ln({p}) END)")
    bp = "(CASE WHEN hyp_len < ref_len THEN (CASE WHEN hyp_len > 0 THEN exp(1.0 - ref_len::DOUBLE / hyp_len) ELSE 0.0 END) ELSE 1.0 END)"
    return f"CASE WHEN c1 + c2 + c3 + c4 = 0 THEN 0.0 ELSE {bp} * exp(({' + '.join(logs)}) / 4.0) END"


SACRE_EXPR = _sacre_expr()


def tok13a(x: str) -> str:
    c = x
    for a, b in (("<skipped>", ""), ("-' || chr(10) || '", ""), ("' || chr(10) || '", " ")):
        c = f"replace({c}, '{a}', '{b}')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, '{a}', '{b}')"
    c = f"(' ' || {c} || ' ')"
    c = rf"regexp_replace({c}, '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g')"
    c = rf"regexp_replace({c}, '([^0-9])([\.,])', '\1 \2 ', 'g')"
    c = rf"regexp_replace({c}, '([\.,])([^0-9])', ' \1 \2', 'g')"
    c = rf"regexp_replace({c}, '([0-9])(-)', '\1 \2 ', 'g')"
    return W(c)


def softmax_sql(asks: str, meets: str, masked: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sc AS (
  SELECT q.vec_id AS query_id, k.v AS v,
    CASE WHEN {masked} THEN -1e9 ELSE list_dot_product(q.v, k.v) / sqrt(len(q.v)) END AS score
  FROM e q JOIN e k ON {meets} WHERE {asks}),
mx AS (SELECT query_id, max(score) AS m FROM sc GROUP BY query_id),
wt AS (SELECT sc.query_id, v, exp(score - m) AS w FROM sc JOIN mx USING (query_id)),
dm AS (SELECT query_id, unnest(v) AS x, unnest(range(len(v))) AS k, w FROM wt)
SELECT query_id, CAST(k AS INTEGER) AS k, round(sum(w * x) / sum(w), 6) AS value FROM dm GROUP BY query_id, k"""


def oracle_sql() -> dict:
    q: dict[str, str] = {}
    q["s1_aligned_roundtrip"] = f"""WITH {LINE_PAIRS}
SELECT CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS line_no, src_text, tgt_text FROM line_pairs"""
    q["s2_read_translations"] = f"WITH {CONV_PAIRS} SELECT pair_id, src_text, tgt_text FROM conv_pairs"
    q["s3_sentences"] = f"WITH {CONV_PAIRS} SELECT pair_id, tgt_text AS text FROM conv_pairs"
    q["s8_latest_artifact"] = """SELECT source || '_' AS base, arg_max('/runs/' || source || '_' || CAST(doc_id AS VARCHAR) || '.pt', doc_id) AS path,
  CAST(max(doc_id) AS BIGINT) AS number FROM documents GROUP BY source"""
    q["f1_flatten_struct"] = q["s2_read_translations"]
    q["s4_training_text"] = "SELECT replace(text, chr(10), ' ') AS line FROM documents"
    q["s5_vocab_roundtrip"] = f"WITH {CONV_PAIRS},\n{vocab_cte('v', 'conv_pairs', 'src_text', SMALL_VOCAB)}\nSELECT piece, id, freq, kind FROM v"
    q["s6_write_examples"] = f"""WITH {CONV_ENC},
{prepared_cte('', 'conv_pairs')}
SELECT p.split, p.batch_id, CAST(p."order" AS BIGINT) AS "order", p.pair_id, {ints('ex.encoder_input')} AS encoder_input
FROM prepared p JOIN ex ON ex.pair_id = p.pair_id WHERE p.kept"""
    q["s7_append_scalars"] = "SELECT event_type AS tag, event_id AS step, value FROM events"
    q["s7_append_batches"] = q["s7_append_scalars"]
    q["f2_length_filter"] = f"""WITH {CONV_PAIRS},
pl AS (SELECT pair_id, CAST(len({W('src_text')}) AS INTEGER) AS src_len, CAST(len({W('tgt_text')}) AS INTEGER) AS tgt_len FROM conv_pairs),
pt AS (SELECT *, {tagged('pl')} AS drop_reason FROM pl)
SELECT pair_id, src_len, tgt_len, drop_reason, drop_reason IS NULL AS kept FROM pt"""
    q["f3_drop_empty"] = f"""WITH {prepared_cte(CONV_PAIRS, 'conv_pairs')}
SELECT split, count(*) AS n_rows, CAST(count(DISTINCT batch_id) AS BIGINT) AS n_batches FROM prepared WHERE kept GROUP BY split"""
    q["f4_normalize_newlines"] = "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents"
    q["f5_check_shapes"] = f"WITH {CONV_ENC} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad FROM ex"
    q["q1_check_vocab"] = f"""WITH {CONV_PAIRS},
{vocab_cte('v', 'conv_pairs', 'src_text', SMALL_VOCAB)},
{encode_cte('e', 'conv_pairs', 'pair_id', 'src_text', 'v')}
SELECT (SELECT count(*) FROM e) AS n_rows, (SELECT count(*) FROM v) AS vocab_size,
  CAST((SELECT min(list_min(ids)) FROM e) AS INTEGER) AS min_id, CAST((SELECT max(list_max(ids)) FROM e) AS INTEGER) AS max_id,
  (SELECT min(list_min(ids)) >= 0 AND max(list_max(ids)) < (SELECT count(*) FROM v) FROM e) AS ids_in_range,
  (SELECT count(*) = 7 FROM v WHERE piece IN {SPECIALS_LIST}) AS specials_present"""
    q["q2_literal_specials"] = """SELECT count(*) AS n_rows,
  CAST(sum(CAST(contains(text, '[PAD]') OR contains(text, '[UNK]') OR contains(text, '[SOS]') OR contains(text, '[EOS]') AS INTEGER)) AS BIGINT) AS n_special_text
FROM documents"""
    q["t1_normalize"] = r"""SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN ''
  ELSE '▁' || replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ', '▁') END AS normalized FROM documents"""
    q["t2_word_counts"] = f"SELECT w AS word, count(*) AS freq FROM (SELECT unnest({W('text')}) AS w FROM documents) GROUP BY w"
    q["t3_char_inventory"] = f"""WITH wc AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest({W('text')}) AS w FROM documents) GROUP BY w)
SELECT ch, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(string_split(word, '')) AS ch, freq FROM wc) GROUP BY ch"""
    q["t4_pair_counts"] = f"""WITH wc AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest({W('text')}) AS w FROM documents) GROUP BY w),
sy AS (SELECT list_concat(['▁'], string_split(word, '')) AS s, freq FROM wc),
pr AS (SELECT s[i] AS l, s[i + 1] AS r, freq FROM (SELECT s, freq, unnest(range(1, len(s))) AS i FROM sy) WHERE {COUNTED.format(x='s')})
SELECT l AS "left", r AS "right", CAST(sum(freq) AS BIGINT) AS n FROM pr GROUP BY l, r"""
    # one merge at a time over the distinct words; symbols stand between bars, so that a merge is a plain replacement
    q["t5_train_bpe"] = f"""WITH RECURSIVE {CONV_PAIRS},
wc AS (SELECT '▁' || w AS word, count(*) AS freq FROM (SELECT unnest({W('src_text')}) AS w FROM conv_pairs) GROUP BY w),
m AS (SELECT {BPE_VOCAB} - 7 - count(DISTINCT ch) AS merges FROM (SELECT unnest(string_split(word, '')) AS ch FROM wc)),
t AS (
  SELECT 0 AS step, '|' || array_to_string(string_split(word, ''), '||') || '|' AS s, freq, '' AS l, '' AS r, CAST(0 AS BIGINT) AS n FROM wc
  UNION ALL
  SELECT t.step + 1, replace(t.s, '|' || b.l || '||' || b.r || '|', '|' || b.l || b.r || '|'), t.freq, b.l, b.r, b.n
  FROM t, m, (
    SELECT x[i] AS l, x[i + 1] AS r, CAST(sum(freq) AS BIGINT) AS n
    FROM (SELECT x, freq, unnest(range(1, len(x))) AS i FROM (SELECT string_split(s[2:length(s) - 1], '||') AS x, freq FROM t))
    WHERE {COUNTED.format(x='x')} GROUP BY ALL ORDER BY n DESC, l, r LIMIT 1) b
  WHERE t.step < m.merges)
SELECT DISTINCT CAST(step - 1 AS INTEGER) AS rank, l AS "left", r AS "right", n FROM t WHERE step > 0"""
    q["t6_with_specials"] = f"WITH {CONV_PAIRS},\n{vocab_cte('v', 'conv_pairs', 'src_text', SMALL_VOCAB)}\nSELECT piece, id, freq, kind FROM v"
    q["t7_piece_to_id"] = f"""WITH {CONV_PAIRS},
{vocab_cte('v', 'conv_pairs', 'src_text', SMALL_VOCAB)},
t AS (SELECT pair_id, unnest({W('src_text')}) AS piece, CAST(unnest(range(len({W('src_text')}))) AS INTEGER) AS pos FROM conv_pairs)
SELECT t.pair_id, t.pos, t.piece, CAST(coalesce(v.id, 0) AS INTEGER) AS id FROM t LEFT JOIN v ON v.piece = t.piece"""
    q["t8_vocab_size"] = f"WITH {CONV_PAIRS},\n{vocab_cte('v', 'conv_pairs', 'src_text', SMALL_VOCAB)}\nSELECT count(*) AS vocab_size FROM v"
    q["t9_bpe_roundtrip"] = f"WITH {CONV_PAIRS} SELECT count(*) AS n_rows, count(*) AS n_equal FROM conv_pairs"
    q["t10_decode"] = f"WITH {CONV_PAIRS} SELECT pair_id, array_to_string({W('src_text')}, ' ') AS text FROM conv_pairs"
    q["t11_encode"] = f"WITH {CONV_ENC} SELECT pair_id, {ints('src_ids')} AS src_ids, {ints('tgt_ids')} AS tgt_ids FROM enc"
    q["t11_char_vocab"] = f"""WITH wc AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest({W('text')}) AS w FROM documents) GROUP BY w),
inv AS (SELECT ch, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(string_split(word, '')) AS ch, freq FROM wc) GROUP BY ch)
SELECT piece, CAST(id AS INTEGER) AS id, CAST(NULL AS BIGINT) AS freq, 'special' AS kind FROM {SPECIALS_VALUES}
UNION ALL
SELECT ch, CAST(row_number() OVER (ORDER BY freq DESC, ch) + 6 AS INTEGER), freq, 'char'
FROM (SELECT * FROM inv WHERE ch NOT IN {SPECIALS_LIST} ORDER BY freq DESC, ch LIMIT 53)"""
    q["t11_char_encode"] = f"""WITH wc AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest({W('text')}) AS w FROM documents) GROUP BY w),
inv AS (SELECT ch, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(string_split(word, '')) AS ch, freq FROM wc) GROUP BY ch),
v AS (
  SELECT piece, id FROM {SPECIALS_VALUES}
  UNION ALL
  SELECT ch, CAST(row_number() OVER (ORDER BY freq DESC, ch) + 6 AS INTEGER)
  FROM (SELECT * FROM inv WHERE ch NOT IN {SPECIALS_LIST} ORDER BY freq DESC, ch LIMIT 53)),
c AS (SELECT doc_id, flatten(list_transform({W('text')}, lambda w: string_split(w, ''))) AS cs FROM documents),
t AS (SELECT doc_id, unnest(cs) AS ch, unnest(range(len(cs))) AS pos FROM c),
g AS (SELECT t.doc_id, list(coalesce(v.id, 0) ORDER BY t.pos) AS ids FROM t LEFT JOIN v ON v.piece = t.ch GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(coalesce(g.ids, [])) AS BIGINT) AS n_ids, md5(array_to_string(coalesce(g.ids, []), ',')) AS ids_md5
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""
    q["e7_examples"] = f"""WITH {CONV_ENC}
SELECT pair_id, src_len, tgt_len, {ints('encoder_input')} AS encoder_input, {ints('decoder_input')} AS decoder_input,
  {ints('label')} AS label, {ints('list_transform(encoder_input, lambda x: CAST(x <> 3 AS INTEGER))')} AS encoder_mask,
  decoder_valid_len FROM ex"""
    q["e5_causal_mask"] = f"""WITH {CONV_ENC}
SELECT pair_id, md5(array_to_string(list_transform(range(decoder_valid_len), lambda i: array_to_string(
  list_transform(range(decoder_valid_len), lambda j: CAST(j <= i AS INTEGER)), '')), '|')) AS mask_md5 FROM ex"""
    q["e6_decoder_mask"] = f"""WITH {CONV_ENC}
SELECT pair_id, md5(array_to_string(list_transform(range(128), lambda i: array_to_string(
  list_transform(range(128), lambda j: CAST(j <= i AND decoder_input[j + 1] <> 3 AS INTEGER)), '')), '|')) AS mask_md5,
  CAST(list_sum(list_transform(range(128), lambda i: len(list_filter(range(128), lambda j: j <= i AND decoder_input[j + 1] <> 3)))) AS BIGINT) AS n_ones
FROM ex"""
    q["e8_inference_source"] = f"WITH {CONV_ENC} SELECT pair_id, {ints('list_concat(src_ids, [6])')} AS source_ids FROM enc"
    q["e9_collate"] = f"""WITH {prepared_cte(CONV_PAIRS, 'conv_pairs')}
SELECT split, batch_id, count(*) AS n_rows, array_to_string(list(pair_id ORDER BY "order"), ',') AS pair_ids
FROM prepared WHERE kept GROUP BY split, batch_id"""
    q["d0_exact_rank"] = f"""WITH {LINE_PAIRS}
SELECT pair_id, CAST(row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42'), pair_id) - 1 AS BIGINT) AS rank FROM line_pairs"""
    q["d1_split"] = f"""WITH {LINE_PAIRS}
SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42'), pair_id) - 1
  < floor(0.9::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM line_pairs"""
    q["d2_shuffle"] = f"""WITH {LINE_PAIRS},
sp AS (SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42'), pair_id) - 1
  < floor(0.9::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM line_pairs),
ep AS (SELECT unnest([0, 1, 2]) AS epoch)
SELECT CAST(epoch AS INTEGER) AS epoch, split, pair_id,
  CAST(row_number() OVER (PARTITION BY epoch, split ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42:' || CAST(epoch AS VARCHAR)), pair_id) - 1 AS BIGINT) AS "order"
FROM sp, ep"""
    epoch_keys = ", ".join(f"({e}, {round_keys(CFG.seed, e)})" for e in range(CFG.num_epochs))
    f = f"((a % side + k) % {MODULUS})"
    f = f"(({f} * {f} % {MODULUS} + k) % {MODULUS})"

    def network(x: str) -> str:
        return f"list_reduce(list_concat([CAST({x} AS BIGINT)], keys), lambda a, k: (a % side) * side + (a // side + {f} * {f} % {MODULUS}) % side)"

    q["d2_permuted_epochs"] = f"""WITH RECURSIVE {LINE_PAIRS},
rk AS (
  SELECT pair_id, row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42'), pair_id) - 1 AS r,
    count(*) OVER () AS n, CAST(floor(0.9::DOUBLE * count(*) OVER ()) AS BIGINT) AS train FROM line_pairs),
sp AS (
  SELECT pair_id, CASE WHEN r < train THEN 'train' ELSE 'validation' END AS split, CASE WHEN r < train THEN r ELSE r - train END AS r,
    CASE WHEN r < train THEN train ELSE n - train END AS n FROM rk),
ep AS (SELECT epoch, CAST(keys AS BIGINT[]) AS keys FROM (VALUES {epoch_keys}) v(epoch, keys)),
st AS (SELECT *, CAST(ceil(sqrt(n::DOUBLE)) AS BIGINT) AS side FROM sp, ep),
wk AS (
  SELECT epoch, keys, split, pair_id, n, side, {network('r')} AS x FROM st
  UNION ALL
  SELECT epoch, keys, split, pair_id, n, side, {network('x')} AS x FROM wk WHERE x >= n)
SELECT CAST(epoch AS INTEGER) AS epoch, split, pair_id, x AS "order" FROM wk WHERE x < n"""
    q["d3_batches"] = f"""WITH {prepared_cte(CONV_PAIRS, 'conv_pairs')}
SELECT pair_id, split, CAST("order" AS BIGINT) AS "order", batch_id, kept FROM prepared"""
    steps_cte = f"""{prepared_cte(CONV_PAIRS, 'conv_pairs')},
ep AS (SELECT unnest(range(20)) AS epoch),
eo AS (
  SELECT epoch, pair_id, kept, row_number() OVER (PARTITION BY epoch ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42:' || CAST(epoch AS VARCHAR)), pair_id) - 1 AS o
  FROM prepared, ep WHERE split = 'train'),
sb AS (SELECT DISTINCT epoch, CAST(floor(o / 8) AS BIGINT) AS batch_id FROM eo WHERE kept),
steps AS (SELECT CAST(epoch AS INTEGER) AS epoch, batch_id, CAST(row_number() OVER (ORDER BY epoch, batch_id) - 1 AS BIGINT) AS step FROM sb)"""
    q["d4_steps"] = f"WITH {steps_cte}\nSELECT epoch, batch_id, step FROM steps"
    q["d5_resume"] = f"""WITH {steps_cte},
done AS (SELECT epoch, max(step) + 1 AS global_step FROM steps WHERE epoch < 10 GROUP BY epoch),
st AS (SELECT arg_max(epoch, epoch) AS e, arg_max(global_step, epoch) AS g FROM done)
SELECT CAST((SELECT coalesce(e, -1) + 1 FROM st) AS INTEGER) AS initial_epoch, CAST((SELECT coalesce(g, 0) FROM st) AS BIGINT) AS initial_step,
  count(*) AS remaining_batches, min(step) AS first_step FROM steps WHERE epoch >= (SELECT coalesce(e, -1) + 1 FROM st)"""
    q["s6_resume_examples"] = f"""WITH {CONV_ENC},
{steps_cte.replace(CONV_PAIRS + ',', '', 1).lstrip()}
SELECT eo.epoch::INTEGER AS epoch, st.step, eo.o::BIGINT AS "order", eo.pair_id, {ints('ex.encoder_input')} AS encoder_input
FROM eo JOIN steps st ON st.epoch = eo.epoch AND st.batch_id = CAST(floor(eo.o / 8) AS BIGINT) JOIN ex ON ex.pair_id = eo.pair_id
WHERE eo.kept AND eo.epoch >= 10"""
    q["d6_validation_sample"] = f"""WITH {prepared_cte(CONV_PAIRS, 'conv_pairs')},
st AS (SELECT unnest([0, 500]) AS step),
c AS (
  SELECT step, pair_id, row_number() OVER (PARTITION BY step ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42:val:' || CAST(step AS VARCHAR)), pair_id) - 1 AS r
  FROM prepared, st WHERE split = 'validation' AND kept)
SELECT CAST(step AS INTEGER) AS step, CAST(r AS INTEGER) AS sample_idx, pair_id FROM c WHERE r < 2"""
    q["a1_max_lengths"] = f"WITH {CONV_ENC} SELECT max(src_len) AS max_src_len, max(tgt_len) AS max_tgt_len FROM enc"
    q["a2_dataset_size"] = f"""WITH {LINE_PAIRS},
sp AS (SELECT CASE WHEN row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || ':42'), pair_id) - 1
  < floor(0.9::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM line_pairs)
SELECT split, count(*) AS n_rows FROM sp GROUP BY split"""
    q["a3_batch_count"] = f"""WITH {prepared_cte(CONV_PAIRS, 'conv_pairs')}
SELECT split, CAST(ceil(count(*) / max(CASE WHEN split = 'train' THEN 8 ELSE 1 END)) AS BIGINT) AS n_batches,
  CAST(count(DISTINCT CASE WHEN kept THEN batch_id END) AS BIGINT) AS n_batches_kept FROM prepared GROUP BY split"""
    q["a4_prep_report"] = report_sql(CONV_PAIRS, "conv_pairs")
    q["a4_prep_report_lines"] = report_sql(LINE_PAIRS, "line_pairs")
    q["a5_latest_scalar"] = "SELECT event_type AS tag, max(event_id) AS last_step, arg_max(value, event_id) AS last_value FROM events GROUP BY event_type"
    q["m1_cer"] = f"""WITH {HYP_REF}
SELECT lang, CAST(sum(levenshtein({_map_letters('hyp')}, {_map_letters('ref')})) AS BIGINT) AS char_edits,
  CAST(sum(length(ref)) AS BIGINT) AS ref_chars,
  round(sum(levenshtein({_map_letters('hyp')}, {_map_letters('ref')}))::DOUBLE / sum(length(ref)), 6) AS cer
FROM hyp_ref GROUP BY lang"""
    q["m2_wer"] = f"""WITH RECURSIVE {HYP_REF},
{word_edits('hyp_ref')}
SELECT lang, CAST(sum(e) AS BIGINT) AS word_edits, CAST(sum(len({W('ref')})) AS BIGINT) AS ref_words,
  round(sum(e)::DOUBLE / sum(len({W('ref')})), 6) AS wer FROM hyp_ref JOIN we USING (id) GROUP BY lang"""
    q["m7_validation_scalars"] = f"""WITH RECURSIVE {HYP_REF},
vs AS (SELECT *, id // 4294967296 AS step FROM hyp_ref),
{metric_scalars('vs')}"""
    q["m7_validation_scalars_last"] = f"""WITH RECURSIVE {HYP_REF},
vs AS (SELECT id, id // 4294967296 AS step, hyp, ref FROM hyp_ref QUALIFY row_number() OVER (PARTITION BY id // 4294967296 ORDER BY id DESC) = 1),
{metric_scalars('vs')}"""
    q["m3_bleu"] = f"""WITH {HYP_REF},
{bleu_counts('hyp_ref', 'hyp', 'ref', 'lang')}
SELECT g AS lang, c1, c2, c3, c4, t1, t2, t3, t4, hyp_len, ref_len, round({BLEU_EXPR}, 6) AS bleu FROM bs"""
    q["m4_corpus_bleu"] = f"""WITH {HYP_REF},
{bleu_counts('hyp_ref', 'hyp', 'ref', 'lang', tok13a)}
SELECT g AS lang, c1, c2, c3, c4, t1, t2, t3, t4, hyp_len, ref_len, round({SACRE_EXPR}, 4) AS bleu FROM bs"""
    q["m5_eval_rows"] = f"""WITH {HYP_REF}
SELECT id, ref AS source, ref AS expected, hyp AS predicted,
  'Source: ' || ref || chr(10) || 'Expected: ' || ref || chr(10) || 'Predicted: ' || hyp || chr(10) AS message FROM hyp_ref"""
    q["m6_eval_steps"] = f"WITH {steps_cte}\nSELECT DISTINCT step FROM steps WHERE step % 500 = 0"
    score_rows = """sr AS (SELECT vec_id AS seq_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS token_id,
  CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings)"""
    q["x1_log_softmax"] = f"""WITH {score_rows},
mx AS (SELECT seq_id, max(score) AS m FROM sr GROUP BY seq_id),
lse AS (SELECT sr.seq_id, max(m) + ln(sum(exp(score - m))) AS l FROM sr JOIN mx USING (seq_id) GROUP BY sr.seq_id)
SELECT seq_id, token_id, round(score - l, 6) AS log_prob FROM sr JOIN lse USING (seq_id)"""
    q["x2_argmax"] = f"""WITH {score_rows}
SELECT seq_id, arg_max(token_id, (score, -token_id)) AS token_id, round(max(score), 6) AS score FROM sr GROUP BY seq_id"""
    q["x3_smoothed_nll"] = f"""WITH {score_rows},
mx AS (SELECT seq_id, max(score) AS m FROM sr GROUP BY seq_id),
lse AS (SELECT sr.seq_id, max(m) + ln(sum(exp(score - m))) AS l FROM sr JOIN mx USING (seq_id) GROUP BY sr.seq_id),
lp AS (SELECT seq_id, token_id, score - l AS log_prob FROM sr JOIN lse USING (seq_id)),
pp AS (
  SELECT lp.seq_id, sum(CASE WHEN token_id = e.label THEN -log_prob END) AS nll, sum(-log_prob) AS a, count(*) AS v
  FROM lp JOIN embeddings e ON e.vec_id = lp.seq_id WHERE e.label <> 3 GROUP BY lp.seq_id)
SELECT round(avg(0.9 * nll + 0.1 * a / v), 6) AS loss, count(*) AS n_positions FROM pp"""
    q["x4_strip_specials"] = f"WITH {CONV_ENC} SELECT pair_id, {ints('src_ids')} AS ids FROM ex"
    q["x5_apply_stop"] = f"""WITH {CONV_ENC},
g AS (SELECT pair_id, list_concat([5], label) AS gen FROM ex)
SELECT pair_id, {ints('gen[1:greatest(least(coalesce(list_position(gen, 6), len(gen)), 64), 1)]')} AS ids FROM g"""
    q["x6_embed"] = f"""WITH {CONV_PAIRS},
{vocab_cte('v', 'conv_pairs', 'src_text', SMALL_VOCAB)},
t AS (SELECT pair_id, unnest({W('src_text')}) AS piece, CAST(unnest(range(len({W('src_text')}))) AS INTEGER) AS pos FROM conv_pairs),
ti AS (SELECT t.pair_id, t.pos, coalesce(v.id, 0) AS token_id FROM t LEFT JOIN v ON v.piece = t.piece)
SELECT ti.pair_id, ti.pos, CAST(ti.token_id AS BIGINT) AS token_id,
  round(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * sqrt(len(e.embedding)))), 6) AS vec_sum,
  round(list_sum(list_transform(e.embedding, lambda x: (CAST(x AS DOUBLE) * sqrt(len(e.embedding))) ** 2)), 4) AS vec_sq
FROM ti JOIN embeddings e ON e.vec_id = ti.token_id"""
    q["x7_softmax_lookup"] = softmax_sql("q.vec_id % 50 = 0", "true", "k.label = 3")
    q["x7_softmax_lookup_blocks"] = softmax_sql("true", "q.label IS NOT DISTINCT FROM k.label", "false")
    q["x8_position_features"] = f"""WITH {CONV_PAIRS},
t AS (SELECT pair_id, CAST(unnest(range(len({W('src_text')}))) AS INTEGER) AS pos FROM conv_pairs),
k AS (SELECT CAST(unnest(range(16)) AS INTEGER) AS k)
SELECT pair_id, pos, k, round(CASE WHEN k % 2 = 0 THEN sin(pos * exp((k - k % 2) * (-ln(10000.0) / 16)))
  ELSE cos(pos * exp((k - k % 2) * (-ln(10000.0) / 16))) END, 6) AS value FROM t, k"""
    q["x9_standardize"] = """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
m AS (SELECT vec_id, e, list_sum(e) / len(e) AS mean FROM s),
sd AS (SELECT vec_id, e, mean, sqrt(list_sum(list_transform(e, lambda x: (x - mean) ** 2)) / (len(e) - 1)) AS std FROM m)
SELECT vec_id, CAST(unnest(range(len(e))) AS INTEGER) AS k, round(unnest(list_transform(e, lambda x: (x - mean) / (std + 1e-6))), 6) AS value FROM sd"""
    q["i1_batch_predict"] = f"""WITH {CONV_PAIRS}
SELECT pair_id, CASE WHEN len({W('src_text')}) = 0 THEN NULL ELSE array_to_string(list_reverse({W('src_text')}), ' ') END AS prediction,
  CASE WHEN len({W('src_text')}) = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN len({W('src_text')}) = 0 THEN 'ValueError: empty input' END AS error FROM conv_pairs"""
    q["i1_bounded_predict"] = f"""WITH {CONV_PAIRS}, n AS (SELECT *, len({W('src_text')}) AS n FROM conv_pairs)
SELECT pair_id, CASE WHEN n BETWEEN 1 AND 127 THEN array_to_string(list_reverse({W('src_text')}), ' ') END AS prediction,
  CASE WHEN n BETWEEN 1 AND 127 THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN n = 0 THEN 'ValueError: empty input' WHEN n > 127 THEN 'ValueError: ' || (n + 1) || ' tokens, at most 128' END AS error FROM n"""
    q["st1_stream_scalars"] = """WITH b AS (
  SELECT CAST(time_bucket(INTERVAL 1 hour, ts) AS TIMESTAMP) AS window_start, event_type AS tag, value FROM events)
SELECT window_start, window_start + INTERVAL 1 hour AS window_end, tag,
  count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max_value
FROM b GROUP BY window_start, tag
HAVING window_start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 10 minutes"""
    q["st2_stream_examples"] = f"""WITH {enc_cte(LINE_PAIRS, 'line_pairs')}
SELECT pair_id, src_len, tgt_len, {ints('encoder_input')} AS encoder_input, {ints('decoder_input')} AS decoder_input,
  {ints('label')} AS label, {ints('list_transform(encoder_input, lambda x: CAST(x <> 3 AS INTEGER))')} AS encoder_mask,
  decoder_valid_len FROM ex"""
    q["st2_stream_examples_rowwise"] = q["st2_stream_examples"]
    q["st3_stream_predict"] = q["i1_batch_predict"]
    return q
