"""License scan by ordered signature rules.

Hundreds of regular expressions, each gated by a keyword: a rule runs on a text only if its keyword
occurs in it. Rules are ordered by priority; a detection whose interval lies inside a longer one is
suppressed, and of equal intervals the one of the earlier rule stays. Of the rest, overlapping ones are
settled by priority: the earlier rule's stays, of one rule the first in the text. Base phrases (a label for words that stand
consecutively) are counted at every place and their labels are never suppressed.

Texts are lower-cased for A-Z only and matched as UTF-8 bytes; a blank in a rule stands for any run
of characters that are no word characters. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

Null text counts as empty: 0 words, no label, score 0. Null ids are kept, repeated rows are scanned
one by one, an empty table gives an empty result, other columns are not read. Very long texts are
scanned as a whole; memory is a small multiple of one text.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = rb"[a-z0-9\x80-\xff]+"
GAP = rb"[^a-z0-9\x80-\xff]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licenses: label, keyword (a name that needn't hold it has a word of its own), names (alternatives of a regex), canonical addresses.
FAMILIES: list[tuple[str, str, list[str], list[str]]] = [
    ("agpl-3.0", "affero", ["gnu affero general public license( version| v)? 3( 0)?", "affero general public license( version| v)? 3"], ["gnu org licenses agpl 3 0"]),
    ("agpl", "affero", ["gnu affero general public license", "affero gpl"], ["gnu org licenses agpl"]),
    ("lgpl-2.1", "lesser", ["(gnu )?lesser general public license( version| v)? 2 1"], ["gnu org licenses (old licenses )?lgpl 2 1"]),
    ("lgpl-3.0", "lesser", ["(gnu )?lesser general public license( version| v)? 3( 0)?"], ["gnu org licenses lgpl 3 0"]),
    ("lgpl-2.0", "library", ["(gnu )?library general public license( version| v)? 2( 0)?"], ["gnu org licenses (old licenses )?lgpl 2 0"]),
    ("lgpl", "lesser", ["(gnu )?lesser general public license"], ["gnu org licenses lgpl"]),
    ("gpl-1.0", "general public", ["(gnu )?general public license( version| v)? 1( 0)?"], ["gnu org licenses (old licenses )?gpl 1 0"]),
    ("gpl-2.0", "general public", ["(gnu )?general public license( version| v)? 2( 0)?", "version 2 of the (gnu )?general public license"], ["gnu org licenses (old licenses )?gpl 2 0"]),
    ("gpl-3.0", "general public", ["(gnu )?general public license( version| v)? 3( 0)?", "version 3 of the (gnu )?general public license"], ["gnu org licenses gpl 3 0"]),
    ("gfdl", "documentation", ["(gnu )?free documentation license"], ["gnu org licenses fdl", "gnu org copyleft fdl"]),
    ("apache-1.1", "apache", ["apache software license( version| v)? 1 1", "apache license( version| v)? 1 1"], ["apache org licenses license 1 1"]),
    ("apache-2.0", "apache", ["apache( software)? license,?( version| v)? 2( 0)?", "apache 2 0"], ["apache org licenses license 2 0"]),
    ("apache", "apache", ["apache( software)? license"], ["apache org licenses"]),
    ("mit", "mit", ["(the )?mit license", "mit licensed", "mit x11 license"], ["opensource org licenses mit"]),
    ("mit-0", "mit", ["mit no attribution( license)?"], ["opensource org licenses mit 0"]),
    ("bsd-4-clause", "bsd", ["(4|four) clause bsd( license)?", "bsd 4 clause", "original bsd license"], ["spdx org licenses bsd 4 clause"]),
    ("bsd-3-clause", "bsd", ["(3|three) clause bsd( license)?", "bsd 3 clause", "(new|revised|modified) bsd license"], ["opensource org licenses bsd 3 clause"]),
    ("bsd-2-clause", "bsd", ["(2|two) clause bsd( license)?", "bsd 2 clause", "(simplified|freebsd) (bsd )?license"], ["opensource org licenses bsd 2 clause"]),
    ("0bsd", "bsd", ["(zero|0) clause bsd( license)?", "bsd zero clause"], ["opensource org licenses 0bsd"]),
    ("bsd", "bsd", ["bsd style license", "bsd licensed?"], ["opensource org licenses bsd license"]),
    ("isc", "isc", ["isc license", "internet systems consortium license"], ["opensource org licenses isc"]),
    ("mpl-1.0", "mozilla", ["mozilla public license( version| v)? 1 0"], ["mozilla org mpl 1 0"]),
    ("mpl-1.1", "mozilla", ["mozilla public license( version| v)? 1 1"], ["mozilla org mpl mpl 1 1"]),
    ("mpl-2.0", "mozilla", ["mozilla public license,?( version| v)? 2( 0)?"], ["mozilla org mpl 2 0"]),
    ("mpl", "mozilla", ["mozilla public license"], ["mozilla org mpl"]),
    ("epl-1.0", "eclipse", ["eclipse public license( version| v)? 1( 0)?"], ["eclipse org legal epl v10"]),
    ("epl-2.0", "eclipse", ["eclipse public license( version| v)? 2( 0)?"], ["eclipse org legal epl 2 0"]),
    ("epl", "eclipse", ["eclipse public license"], ["eclipse org legal"]),
    ("edl-1.0", "eclipse", ["eclipse distribution license"], ["eclipse org org documents edl"]),
    ("cddl-1.0", "common development", ["common development and distribution license"], ["opensource org licenses cddl"]),
    ("cpl-1.0", "common public", ["common public license"], ["opensource org licenses cpl1 0"]),
    ("ipl-1.0", "ibm", ["ibm public license"], ["opensource org licenses ibmpl"]),
    ("artistic-1.0", "artistic", ["artistic license( version| v)? 1( 0)?"], ["opensource org licenses artistic license 1 0"]),
    ("artistic-2.0", "artistic", ["artistic license( version| v)? 2( 0)?"], ["opensource org licenses artistic license 2 0"]),
    ("artistic", "artistic", ["(perl )?artistic license"], ["perl org artistic"]),
    ("bsl-1.0", "boost", ["boost software license"], ["boost org license 1 0"]),
    ("zlib", "zlib", ["zlib (libpng )?license"], ["opensource org licenses zlib"]),
    ("libpng", "libpng", ["libpng license"], ["libpng org pub png src libpng license"]),
    ("unlicense", "unlicense", ["the unlicense", "this is free and unencumbered software"], ["unlicense org"]),
    ("wtfpl", "wtf", ["wtfpl", "do what the f[a-z]* you want to public license"], ["wtfpl net"]),
    ("eupl-1.2", "european union", ["european union public licen[cs]e( version| v)? 1 2"], ["joinup ec europa eu [a-z ]*eupl"]),
    ("eupl", "european union", ["european union public licen[cs]e"], ["eupl eu"]),
    ("python-2.0", "python", ["python software foundation license", "psf license agreement"], ["docs python org 3 license"]),
    ("php-3.01", "php", ["php license( version| v)? 3"], ["php net license"]),
    ("postgresql", "postgresql", ["postgresql licen[cs]e"], ["postgresql org about licence"]),
    ("openssl", "openssl", ["openssl license"], ["openssl org source license"]),
    ("ofl-1.1", "open font", ["(sil )?open font license"], ["scripts sil org ofl"]),
    ("ms-pl", "microsoft", ["microsoft public license"], ["opensource org licenses ms pl"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"], ["opensource org licenses ms rl"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], ["opensource org licenses ncsa"]),
    ("afl-3.0", "academic free", ["academic free license"], ["opensource org licenses afl 3 0"]),
    ("osl-3.0", "open software", ["open software license( version| v)? 3"], ["opensource org licenses osl 3 0"]),
    ("ecl-2.0", "educational", ["educational community license"], ["opensource org licenses ecl2"]),
    ("upl-1.0", "universal permissive", ["universal permissive license"], ["oss oracle com licenses upl"]),
    ("vim", "vim", ["vim license"], ["vimdoc sourceforge net htmldoc uganda"]),
    ("w3c", "w3c", ["w3c software (notice and )?license"], ["w3 org consortium legal 2015 copyright software"]),
    ("sspl-1.0", "server side", ["server side public license"], ["mongodb com licensing server side public license"]),
    ("busl-1.1", "business source", ["business source license"], ["mariadb com bsl11"]),
    ("elastic-2.0", "elastic", ["elastic license"], ["elastic co licensing elastic license"]),
    ("commons-clause", "commons clause", ["commons clause( license)?"], ["commonsclause com"]),
    ("polyform", "polyform", ["polyform (noncommercial|small business|shield|internal use|strict) license"], ["polyformproject org licenses"]),
    ("openrail", "openrail", ["(creativeml )?openrail[ a-z]{0,4} license", "(creativeml )?open rail m"], ["licenses ai"]),
    ("cc0-1.0", "cc0", ["cc0( 1 0)?", "cc0 1 0 universal"], ["creativecommons org publicdomain zero"]),
    ("cc-by-nc-nd", "cc by", ["cc by nc nd( [1-4] [05])?"], ["creativecommons org licenses by nc nd"]),
    ("cc-by-nc-sa", "cc by", ["cc by nc sa( [1-4] [05])?"], ["creativecommons org licenses by nc sa"]),
    ("cc-by-nc", "cc by", ["cc by nc( [1-4] [05])?"], ["creativecommons org licenses by nc"]),
    ("cc-by-nd", "cc by", ["cc by nd( [1-4] [05])?"], ["creativecommons org licenses by nd"]),
    ("cc-by-sa", "cc by", ["cc by sa( [1-4] [05])?"], ["creativecommons org licenses by sa"]),
    ("cc-by-4.0", "cc by", ["cc by 4 0"], ["creativecommons org licenses by 4 0"]),
    ("cc-by-3.0", "cc by", ["cc by 3 0"], ["creativecommons org licenses by 3 0"]),
    ("cc-by-2.0", "cc by", ["cc by 2 [05]"], ["creativecommons org licenses by 2"]),
    ("cc-by-nc-sa", "creative commons", ["creative commons attribution non ?commercial share ?alike"], []),
    ("cc-by-nc-nd", "creative commons", ["creative commons attribution non ?commercial no ?deriv(ative)?s?"], []),
    ("cc-by-nc", "creative commons", ["creative commons attribution non ?commercial"], []),
    ("cc-by-sa", "creative commons", ["creative commons attribution share ?alike"], []),
    ("cc-by-nd", "creative commons", ["creative commons attribution no ?deriv(ative)?s?"], []),
    ("cc", "creative commons", ["creative commons( attribution)?( license)?"], ["creativecommons org licenses"]),
    ("odc-odbl", "open data", ["open (data commons open )?database license"], ["opendatacommons org licenses odbl"]),
    ("odc-by", "open data", ["open data commons attribution license"], ["opendatacommons org licenses by"]),
    ("pddl", "public domain dedication", ["(open data commons )?public domain dedication( and)? license"], ["opendatacommons org licenses pddl"]),
    ("cdla-permissive", "community data", ["community data license agreement permissive"], ["cdla dev permissive"]),
    ("cdla-sharing", "community data", ["community data license agreement sharing"], ["cdla dev sharing"]),
    ("ogl-uk", "open government", ["open government licen[cs]e"], ["nationalarchives gov uk doc open government licence"]),
]
#: Phrases that tell of terms without naming a license: label, keyword, pattern.
NOTICES: list[tuple[str, str, str]] = [
    ("mit", "permission is", "permission is hereby granted,? free of charge"),
    ("isc", "permission to", "permission to use copy modify and or distribute this software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms"),
    ("apache-2.0", "licensed under", "licensed under the apache license"),
    ("boost", "permission is", "permission is hereby granted to any person or organization"),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty"),
    ("gpl-or-later", "later version", "either version [23] of the license or at your option any later version"),
    ("gpl-or-later", "later version", "or any later version"),
    ("public-domain", "public domain", "(released|placed|dedicated) (in|in to|into|to) the public domain"),
    ("public-domain", "public domain", "this work is in the public domain"),
    ("public-domain", "public domain", "no copyright public domain"),
    ("copyright", "copyright", "copyright( c| ©)? (19|20)[0-9][0-9]"),
    ("copyright", "copyright", "copyright by [a-z]+"),
    ("copyright", "copyrighted", "copyrighted material"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "without", "(no|not be) [a-z ]{0,40}reproduced [a-z ]{0,60}without (the )?(prior )?(written )?permission"),
    ("proprietary", "unauthorized", "unauthorized (copying|reproduction|distribution|use)"),
    ("proprietary", "trade secret", "trade secrets? of"),
    ("reserved", "rights reserved", "some rights reserved"),
    ("reserved", "droits", "tous droits réservés"),
    ("reserved", "rechte", "alle rechte vorbehalten"),
    ("reserved", "derechos", "todos los derechos reservados"),
    ("reserved", "diritti", "tutti i diritti riservati"),
    ("terms-of-use", "terms of", "terms of (use|service)"),
    ("non-commercial", "commercial", "for (personal|non ?commercial) (use|purposes) only"),
    ("non-commercial", "commercial", "not for commercial use"),
    ("warranty", "warranty", "without warranty of any kind"),
    ("warranty", "warranties", "without warranties or conditions of any kind"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    weight: float


def phrase(pattern: str) -> re.Pattern[bytes]:
    """Compile a rule: blanks are gaps between words; the match starts and ends at word ends."""
    body, inside = [], False
    for ch in pattern:  # blanks in character classes stay as they are
        inside = (inside or ch == "[") and ch != "]"
        body.append("\0" if ch == " " and not inside else ch)
    text = "".join(body).replace("\0?", "\1").replace(",?", "")
    raw = text.encode().replace(b"\0", GAP).replace(b"\1", b"(?:" + GAP + b")?")
    return re.compile(rb"(?<![a-z0-9\x80-\xff])(?:" + raw + rb")(?![a-z0-9\x80-\xff])")


def gate(pattern: str, keyword: str) -> bytes:
    """The keyword if every match of the pattern holds it, or else the longest literal that every match holds."""
    while (bare := re.sub(r"\([^()]*\)[?*+]?", " ", pattern)) != pattern:
        pattern = bare
    literals = re.sub(r"\[[^]]*\](\{[^}]*\}|[?*+])?|.\?", " ", pattern).split()
    return (keyword if any(keyword in x for x in literals) else max(literals, key=len)).encode()


def rules() -> list[Rule]:
    """All rules in order of priority: identifiers, addresses, named licenses, notices."""
    tags, links, names = [], [], []
    for label, keyword, alternatives, addresses in FAMILIES:
        tags.append(Rule(label, b"spdx", phrase("spdx license identifier " + label.replace("-", " ").replace(".", " ")), 0.95))
        links += [Rule(label, a.split()[0].encode(), phrase(a), 0.9) for a in addresses]
        first = keyword.split()[0]
        names += [Rule(label, gate(n, first), phrase("((distributed|released|available|licensed|published) under (the |a )?(terms of the )?)(" + n + ")"), 0.9) for n in alternatives]
        names += [Rule(label, gate(n, first), phrase(n), 0.75) for n in alternatives]
    return tags + links + names + [Rule(label, gate(p, k.split()[0]), phrase(p), 0.5) for label, k, p in NOTICES]


def resolved(found: list[tuple[int, int, str, float, int]]) -> list[tuple[int, int, str, float]]:
    """Detections (start, end, label, weight, rank) that no other one contains, without those that overlap one of an earlier rule.

    By start, longest first, one sweep drops what is contained. Starts and ends of the rest both ascend,
    so a detection can only overlap its neighbours among those accepted before.
    """
    free, reach = [], -1
    for d in sorted(found, key=lambda d: (d[0], -d[1], d[4])):
        if d[1] > reach:
            free.append(d)
            reach = d[1]
    kept: list[tuple[int, int, str, float, int]] = []
    for d in sorted(free, key=lambda d: (d[4], d[0])):
        at = bisect(kept, d[0], key=lambda k: k[0])
        if (at == 0 or kept[at - 1][1] <= d[0]) and (at == len(kept) or d[1] <= kept[at][0]):
            kept.insert(at, d)
    return [d[:4] for d in kept]


class Scanner:
    def __init__(self, base: dict[str, str] = BASE):
        self.rules = rules()
        self.base = [(label, p.split()[0].encode(), phrase(p)) for p, label in base.items()]
        self.keywords = sorted({r.keyword for r in self.rules} | {k for _, k, _ in self.base})
        self.words = re.compile(WORD)

    def detections(self, text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Base places, and the rules' detections that suppression leaves; `text` is lower-cased."""
        present = {k for k in self.keywords if k in text}
        if not present:
            return [], []
        places = [(m.start(), m.end(), label) for label, k, p in self.base if k in present for m in p.finditer(text)]
        found = [(m.start(), m.end(), r.label, r.weight, rank) for rank, r in enumerate(self.rules) if r.keyword in present for m in r.pattern.finditer(text)]
        return places, resolved(found)

    def scan(self, text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        n_words = sum(1 for _ in self.words.finditer(data)) if len(data) > 1 << 22 else len(self.words.findall(data))
        places, kept = self.detections(data)
        first = last = None
        if places:
            low, high = min(p[0] for p in places), max(p[0] for p in places)
            first = sum(1 for _ in self.words.finditer(data, 0, low))
            last = first + sum(1 for _ in self.words.finditer(data, low, high))
        base = {p[2] for p in places}
        miss = 1.0
        for label in sorted(base - {d[2] for d in kept}):
            miss *= 0.3 if label != "reserved" else 0.5
        for weight in sorted({(d[2], d[3]) for d in kept}):
            miss *= 1 - weight[1]
        return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {d[2] for d in kept})), 1 - miss, [{"start": s, "end": e, "label": label} for s, e, label, _ in kept]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: counts, word places, labels, score and `spans` (byte ranges of the kept detections)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    long, text = T.LongType(), T.StringType()
    span = T.StructType([T.StructField("start", long), T.StructField("end", long), T.StructField("label", text)])
    names = [("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", text), ("labels", text), ("score", T.DoubleType()), ("spans", T.ArrayType(span))]
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in names)])
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)
