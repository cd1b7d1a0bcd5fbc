"""License notices by conditional compression.

A candidate block is a run of lines that hold a trigger word, with up to three lines around it where they are short, and
with all lines around it that consist mostly of words of the templates (blank lines between them too), so that a license
text of many lines is one block; a line of any length is searched whole, in time that follows the square of a block's
words at worst. Every block is compressed by itself and with each template as zstandard raw dictionary; the
templates are ranked by the bytes that the dictionary saves. In this order all are held against the exact wording until
one is confirmed, so the ranking decides the order only: a template's words are aligned to the block's and the differences
(words missing or put in between) counted; at most MOST_DIFFERENT of them may differ, and no word of the template with a
digit or in its own key words may be missing. A confirmed notice's words are taken out and the rest ranked again, so a
block may hold several; lines with a trigger word go first, then what is left.

Null and empty texts have no licenses; an empty table gives an empty one. Ties of saved bytes go by template name. Repeated rows get equal results; columns
named like a result are replaced. A worker keeps a bounded memory of blocks seen.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table, text_slices

#: Notices by SPDX-like name: the words looked for, and the key words that must all be there. The usual
#: short notices, the first sentences of licenses, and whole license texts (names that end in -full).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "apache 2.0"),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "apache 2.0 compliance",
    ),
    "MIT": ("Released under the MIT License", "mit license"),
    "MIT-text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted free charge"),
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "permission granted sublicense noninfringement",
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "permission fee granted disclaims tortious",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "gnu public 3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "gnu public 2"),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gnu public foundation 3 warranty",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", "gnu lesser 3"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", "gnu affero 3"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution source binary permitted"),
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "redistributions endorse disclaimer exemplary",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "cc by 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "cc by-sa 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "cc by-nc 4.0"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "cc0 1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "unencumbered public domain"),
    "ARR": ("All rights reserved", "rights reserved"),
}
#: White space inside is any, so a phrase that wraps over a line break is seen.
TRIGGER = r"(?i)licen[sc]|copyright|all\s+rights\s+reserved|public\s+domain|CC[-\s]BY|CC0|hereby\s+granted|redistribution|without\s+warranty"
_TRIGGER, _WORD = re.compile(TRIGGER), re.compile(r"[\w][\w.\-+]*\w|\w")
MOST_DIFFERENT = 0.25
AROUND_CHARS = 200
#: A neighbouring line of any length joins a block where this share of its words are words of the templates.
LIKE_TEMPLATES = 0.7
#: Templates of so many words are license texts rather than short notices.
LONG_WORDS = 40
SEEN_BLOCKS = 20_000


def block_words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@functools.lru_cache(1)
def compressors() -> dict:
    """Name -> (compressor with the template as raw dictionary, saving on the template itself, words, key words)."""
    import zstandard as zstd

    plain, out = zstd.ZstdCompressor(level=3), {}
    for name, (notice, keys) in TEMPLATES.items():
        words = block_words(notice)
        data = " ".join(words).encode()
        own = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT))
        out[name] = (own, len(plain.compress(data)) - len(own.compress(data)), words, {w for w in words if any(c.isdigit() for c in w)} | set(keys.split()))
    return {"plain": plain, "by": out}


@functools.lru_cache(1)
def _template_words() -> frozenset:
    return frozenset(w for notice, _ in TEMPLATES.values() for w in block_words(notice))


@functools.lru_cache(64)
def _fits(line: str) -> bool:
    """Whether a line, whole, is made of the templates' words."""
    known, words = _template_words(), block_words(line)
    return bool(words) and sum(w in known for w in words) >= (LIKE_TEMPLATES * len(words) if len(words) > 2 else len(words))


def _widened(text: str, low: int, high: int) -> tuple[int, int]:
    """The span with the lines before and after it that are made of the templates' words, over single blank lines."""
    while low:
        end = low - 1
        if end and text[end - 1] == "\n":
            end -= 1
        before = text.rfind("\n", 0, end) + 1
        if not _fits(text[before:end]):
            break
        low = before
    while high < len(text):
        start = high + 1
        if text[start : start + 1] == "\n":
            start += 1
        after = text.find("\n", start)
        after = len(text) if after < 0 else after
        if not _fits(text[start:after]):
            break
        high = after
    return low, high


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Spans of the lines with a trigger word; neighbours join them where both are short, and touching spans are one."""
    spans: list[list[int]] = []
    for hit in _TRIGGER.finditer(text):
        low, high = text.rfind("\n", 0, hit.start()) + 1, text.find("\n", hit.end())
        high = len(text) if high < 0 else high
        for _ in range(3):  # notices that wrap over a few short lines
            before = text.rfind("\n", 0, max(0, low - 1)) + 1
            if low and low - before <= AROUND_CHARS and high - low <= AROUND_CHARS:
                low = before
            after = text.find("\n", high + 1)
            after = len(text) if after < 0 else after
            if high < len(text) and after - high <= AROUND_CHARS and high - low <= AROUND_CHARS:
                high = after
        low, high = _widened(text, low, high)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])
    return [(a, b) for a, b in spans]


def wording(template: list[str], words: list[str], keys: set[str]) -> tuple[int, int, int] | None:
    """Differences and the span of the block's words that the template covers, or None where it is not confirmed."""
    matcher = SequenceMatcher(None, template, words, autojunk=False)
    parts = [m for m in matcher.get_matching_blocks() if m.size]
    if not parts:
        return None
    low, high = parts[0].b, parts[-1].b + parts[-1].size
    while len(parts) > 1 and high - low > 2 * len(template):  # a stray early or late word does not stretch the span
        parts.remove(min((parts[0], parts[-1]), key=lambda m: m.size))
        low, high = parts[0].b, parts[-1].b + parts[-1].size
    same = sum(m.size for m in parts)
    different = (len(template) - same) + (high - low - same)
    if different > MOST_DIFFERENT * len(template) or not keys <= set(words[low:high]):
        return None
    return different, low, high


def ranked(words: list[str]) -> list[tuple[str, float]]:
    """(license, share of the possible saving), most saved bytes first."""
    tools, data = compressors(), " ".join(words).encode()
    alone = len(tools["plain"].compress(data))
    saved = {name: alone - len(own.compress(data)) for name, (own, *_) in tools["by"].items()}
    return [(name, saved[name] / tools["by"][name][1]) for name in sorted(saved, key=lambda n: (-saved[n], n))]


def confirmed(words: list[str], least: int = 0) -> tuple[list[tuple[str, int, float]], list[str]]:
    """Notices of templates of at least so many words, confirmed one after the other, and the words left."""
    out, by = [], {name: tool for name, tool in compressors()["by"].items() if len(tool[2]) >= least}
    while words:
        there = set(words)
        if not any(keys <= there for *_, keys in by.values()):
            break
        for name, share in ranked(words):
            if name in by and by[name][3] <= there and (found := wording(by[name][2], words, by[name][3])):
                out.append((name, found[0], round(share, 4)))
                words = words[: found[1]] + words[found[2] :]
                break
        else:
            break
    return out, words


def scan_block(text: str) -> list[tuple[str, int, float]]:
    """(license, wording differences, share of the possible saving) of each notice: license texts, which fill many lines,
    first; then, where there are none, trigger lines; then what is left."""
    out, left = confirmed(block_words(text), LONG_WORDS)
    if not out:
        left = []
        for line in text.split("\n"):
            words = block_words(line)
            if _TRIGGER.search(line):
                found, words = confirmed(words)
                out += found
            left += words
    return out + (confirmed(left)[0] if _TRIGGER.search(" ".join(left)) else [])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document with n_blocks (candidates), and matches: license, differences, saving, start and end of the block."""
    match = T.ArrayType(T.StructType.fromDDL("license string, differences int, saving double, block_start int, block_end int"))
    keep = [c for c in docs.columns if c not in (text, "n_blocks", "matches")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_blocks", T.IntegerType()), T.StructField("matches", match)])
    kind = pa.list_(pa.struct([("license", pa.string()), ("differences", pa.int32()), ("saving", pa.float64()), ("block_start", pa.int32()), ("block_end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for batch in (part for whole in batches for part in text_slices(whole, text)):
            likely = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column(text), TRIGGER), False), bool)
            counts, rows = np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(likely):
                value = batch.column(text)[int(i)].as_py()
                spans = candidate_blocks(value)
                counts[i] = len(spans)
                for low, high in spans:
                    block = value[low:high]
                    if block not in seen:
                        if len(seen) >= SEEN_BLOCKS:
                            seen.clear()
                        seen[block] = scan_block(block)
                    rows[i] += [{"license": name, "differences": d, "saving": s, "block_start": low, "block_end": high} for name, d, s in seen[block]]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(counts), pa.array(rows, kind)], names=[*keep, "n_blocks", "matches"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",")
    total = F.aggregate("matches", F.lit(0), lambda a, m: a + m["differences"])
    return found.select("doc_id", "n_blocks", F.size("matches").alias("n_notices"), names.alias("licenses"), total.alias("differences"))
