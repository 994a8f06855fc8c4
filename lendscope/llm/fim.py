"""Fill-in-middle transformation by repeated-capture matching.

A text is matched whole by ``(unit)*`` of the regex library, which keeps every
repetition of the group: ``match.ends(1)`` is the list of all unit ends, so its
length is the number of units n and two look-ups in it are the cut offsets; no
loop runs over the units.  Units are matched left to right (production: one
code point each; any pattern that tiles texts can be given, such as words with
their spaces).

The first four 8-digit groups h1 to h4 of sha256(``<seed>:<doc_id>``) decide:
the prefix ends after the smaller, the middle after the larger of h1 % (n + 1)
and h2 % (n + 1) units; h3 % 100 >= ``fim_percent`` leaves the text plain;
h4 % 100 < ``spm_percent`` puts the suffix first (spm), else the prefix (psm).

Defined results: a null text counts as empty; empty texts, texts that contain
a sentinel and texts that the unit does not tile (n = 0) are plain; plain
texts are returned as they are, with null prefix_chars and middle_chars; a
null doc_id counts as the empty string after ``<seed>:``; rows that repeat an
id get equal cuts for equal lengths; bytes that are no UTF-8 count as one unit
each and come back unchanged.  Columns of the input that clash with n, form,
prefix_chars, middle_chars and output are replaced.  An empty table gives no
rows.  Texts are never cut off: memory is about 45 bytes a unit of the one
longest text (its list of ends) beside a batch of 4 MB; one narrow stage, no
shuffle, so a lost executor repeats its own tasks only.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

CODE_POINT = "(?s:.)"
SENTINELS = ("<P>", "<S>", "<M>")
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be found again in a text that holds none of them: no
    part at the end of one (or a whole one) begins another or itself."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def groups_of(seed: int, doc_id) -> tuple[int, int, int, int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))


def transform(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20,
              sentinels: tuple[str, str, str] = SENTINELS, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with n, form (plain, psm
    or spm), prefix_chars, middle_chars (code points) and output."""
    check_sentinels(sentinels)
    made: list = []

    def one(text: str, doc_id):
        match = made[0].fullmatch(text)
        ends = match.ends(1) if match else []
        n = len(ends)
        h1, h2, h3, h4 = groups_of(seed, doc_id)
        if n == 0 or h3 % 100 >= fim_percent or any(s in text for s in sentinels):
            return n, "plain", None, None, text
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (lo, hi))
        p, s, m = sentinels
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_percent:
            return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def run(views, batch):
        import regex

        if not made:
            made.append(regex.compile(f"({unit})*"))
        rows = [one(bytes(v).decode("utf-8", "surrogateescape"), i) for v, i in zip(views, batch.column(1).to_pylist())]
        n, form, prefix, middle, out = zip(*rows) if rows else ((),) * 5
        out = pa.array([t.encode("utf-8", "surrogateescape") for t in out], pa.binary())
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), out.view(pa.string())]

    return map_texts(docs, run, SCHEMA, ["doc_id"], carry)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from the output and its form."""
    p, s, m = sentinels

    def part(order: str) -> Column:
        first, second = (p, s) if order == "psm" else (s, p)
        head = F.substring_index(output, second, 1).substr(F.lit(len(first) + 1), F.length(output))
        mid = F.substring_index(F.substring_index(output, m, 1), second, -1)
        last = F.substring_index(output, m, -1)
        return F.concat(head, last, mid) if order == "psm" else F.concat(mid, last, head)

    return F.when(form == "psm", part("psm")).when(form == "spm", part("spm")).otherwise(output)


#: The registered query in SQL.
ORACLE_SQL = """
WITH h AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST(('0x' || substr(d, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(d, 9, 8)) AS BIGINT) AS h2,
  CAST(('0x' || substr(d, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(d, 25, 8)) AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
