"""Plans for contextual word similarity: occurrences, contexts, vector scores and their quality."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Spark

#: Raw cosine that the calibration maps to 0.80, characters of context on each side.
CUTOFF, TARGET, SIDE = 0.63, 0.80, 256


def tokens(d: Spark) -> str:
    """The target of a document is its third token; offsets from the lengths of what lies before each token."""
    first = (
        f"picked AS (SELECT doc_id, lang, body, toks, {d.split('body', T.TOKEN)} AS gaps, lower({d.item('toks', '3')}) AS target FROM"
        f" (SELECT doc_id, lang, body, {d.extract_all('body', T.TOKEN)} AS toks FROM (SELECT doc_id, lang, text AS body FROM documents WHERE text IS NOT NULL) a) b)"
    )
    rows = d.unnest_both("toks", "gaps", "doc_id, target", "picked", "i", "tok", "gap")
    w = "OVER (PARTITION BY doc_id ORDER BY i)"
    return (
        f"{first}, listed AS ({rows}), placed AS (SELECT doc_id, target, i, tok, CAST(sum(length(gap)) {w} + sum(length(tok)) {w} - length(tok) AS BIGINT) AS start FROM listed WHERE tok IS NOT NULL),"
        f" found AS (SELECT doc_id, target, i, tok, start, CAST(start + length(tok) AS BIGINT) AS stop FROM placed WHERE lower(tok) = target)"
    )


def word_occurrences(d: Spark) -> str:
    return f"WITH {tokens(d)} SELECT doc_id, target, i AS token_index, start, stop FROM found"


def target_contexts(d: Spark) -> str:
    """256 characters around the first occurrence, also with every occurrence in them masked, and the tokens beside it.

    Marks show where text was cut off. A document is read as two sentences that share the target, parted before
    its second occurrence: the frame bonus is given where both go on with 'of'. Only the cut text meets the occurrences.
    """
    near = lambda x: f"CASE WHEN {x} IS NOT NULL THEN lower({x}) END"
    marked = lambda x: f"concat(CASE WHEN lo > 0 THEN '... ' ELSE '' END, {x}, CASE WHEN hi < chars THEN ' ...' ELSE '' END)"
    piece = f"concat({d.chars('f.cut', 'before - lo + 1', 'start - before')}, '[TARGET]')"
    return (
        f"WITH {tokens(d)}, firsts AS (SELECT doc_id, min(start) AS start, min(stop) AS stop, min(i) AS i FROM found GROUP BY doc_id), seconds AS (SELECT f.doc_id, min(f.i) AS i FROM found f JOIN firsts o ON o.doc_id = f.doc_id AND f.i > o.i GROUP BY f.doc_id),"
        f" spans AS (SELECT o.doc_id, o.i, s.i AS i2, p.target, p.toks, greatest(0, o.start - {SIDE}) AS lo, least(length(p.body), o.stop + {SIDE}) AS hi, length(p.body) AS chars, p.body FROM firsts o JOIN picked p ON p.doc_id = o.doc_id LEFT JOIN seconds s ON s.doc_id = o.doc_id),"
        f" framed AS (SELECT doc_id, target, lo, hi, chars, {d.chars('body', 'lo + 1', 'hi - lo')} AS cut, CASE WHEN i > 0 THEN {near(d.item('toks', 'greatest(i, 1)'))} END AS before, CASE WHEN i2 IS NULL OR i + 1 < i2 THEN {near(d.item('toks', 'i + 2'))} END AS following,"
        f" {near(d.item('toks', 'i2 + 2'))} AS following2 FROM spans),"
        f" inside AS (SELECT f.doc_id, f.start, f.stop, r.lo, r.cut, coalesce(lag(f.stop) OVER (PARTITION BY f.doc_id ORDER BY f.start), r.lo) AS before FROM found f JOIN framed r ON r.doc_id = f.doc_id WHERE f.start >= r.lo AND f.stop <= r.hi),"
        f" masks AS (SELECT f.doc_id, {d.listagg(piece, '', 'start')} AS masked, max(stop) AS last FROM inside f GROUP BY f.doc_id)"
        f" SELECT r.doc_id, r.target, {marked('cut')} AS context, concat('Target word: \"', r.target, '\". Sentence context (target masked): ', {marked('masked, ' + d.chars('cut', 'last - lo + 1', 'hi - last'))}) AS masked, r.before AS before,"
        f" following AS after, CASE WHEN following = 'of' AND following2 = 'of' THEN 0.25e0 ELSE 0e0 END AS frame_bonus FROM framed r JOIN masks m ON m.doc_id = r.doc_id"
    )


def scored(d: Spark) -> str:
    """Every vector against the next one by id: cosine, calibrated score, whether labels agree."""
    cosine = f"greatest(-1e0, least(1e0, {d.dot('v', 'u')} / sqrt({d.dot('v', 'v')} * {d.dot('u', 'u')})))"
    return (
        "pairs AS (SELECT a.vec_id, a.label, a.embedding AS v, b.embedding AS u, b.label AS next_label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
        f", cosines AS (SELECT vec_id, label = next_label AS same, round({cosine}, 6) AS cosine FROM pairs WHERE u IS NOT NULL),"
        f" scored AS (SELECT vec_id, same, cosine, round(greatest(-1e0, least(1e0, CASE WHEN cosine <= {CUTOFF}e0 THEN cosine * {TARGET}e0 / {CUTOFF}e0"
        f" ELSE {TARGET}e0 + (cosine - {CUTOFF}e0) * (1 - {TARGET}e0) / (1 - {CUTOFF}e0) END)), 6) AS score FROM cosines)"
    )


def cosine_pairs(d: Spark) -> str:
    return f"WITH {scored(d)} SELECT vec_id, cosine FROM scored"


def calibrated_similarity(d: Spark) -> str:
    return f"WITH {scored(d)} SELECT vec_id, score, score >= {TARGET}e0 AS is_similar FROM scored"


def ratio(top: str, bottom: str) -> str:
    return f"round(coalesce(CAST({top} AS DOUBLE) / nullif({bottom}, 0), 0e0), 6)"


CUT = 0.1


def classification_metrics(d: Spark) -> str:
    counts = ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in (("tp", "same AND hit"), ("fp", "NOT same AND hit"), ("fn", "same AND NOT hit"), ("tn", "NOT same AND NOT hit")))
    return (
        f"WITH {scored(d)}, counted AS (SELECT {counts} FROM (SELECT same, score >= {CUT}e0 AS hit FROM scored) a) SELECT tp, fp, fn, tn, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy,"
        f" {ratio('tp', 'tp + fp')} AS precision_value, {ratio('tp', 'tp + fn')} AS recall_value, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM counted"
    )


def roc_auc(d: Spark) -> str:
    """Mann-Whitney by mean ranks, counted over distinct scores: no pairs of positives and negatives."""
    below = "OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        f"WITH {scored(d)}, levels AS (SELECT score, sum(CASE WHEN same THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN same THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY score),"
        f" ranked AS (SELECT pos, neg, coalesce(sum(neg) {below}, 0) AS lower_neg FROM levels)"
        f" SELECT {ratio('sum(pos * (lower_neg + neg / 2e0))', 'sum(pos) * sum(neg)')} AS auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM ranked"
    )


def best_threshold(d: Spark) -> str:
    """Over 0.80 and all scores, the threshold of highest accuracy, then F1, then the lowest."""
    upto = "OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = "OVER ()"
    return (
        f"WITH {scored(d)}, levels AS (SELECT t, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT score AS t, CASE WHEN same THEN 1 ELSE 0 END AS pos, CASE WHEN same THEN 0 ELSE 1 END AS neg FROM scored"
        f" UNION ALL SELECT 0.8e0, 0, 0) a GROUP BY t), summed AS (SELECT t, sum(pos) {upto} AS tp, sum(neg) {upto} AS fp, sum(pos) {whole} AS all_pos, sum(neg) {whole} AS all_neg FROM levels),"
        f" rated AS (SELECT t, {ratio('tp + all_neg - fp', 'all_pos + all_neg')} AS accuracy, {ratio('2 * tp', 'all_pos + tp + fp')} AS f1 FROM summed)"
        f" SELECT t AS threshold, accuracy, f1 FROM (SELECT t, accuracy, f1, row_number() OVER (ORDER BY accuracy DESC, f1 DESC, t) AS r FROM rated) a WHERE r = 1"
    )


PLANS = (word_occurrences, target_contexts, cosine_pairs, calibrated_similarity, classification_metrics, roc_auc, best_threshold)
