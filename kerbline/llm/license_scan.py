"""License scans: ordered signature rules behind a keyword prefilter.

Rules come from a table of licenses and, for each of them, rules for its SPDX tag, address, grant and name. One pass over the
text with an Aho-Corasick automaton finds which keywords stand in it, and only rules with a found keyword run. Detections are
taken by priority, then start; one that lies within a detection already taken is dropped. Null and empty texts give no
detection; long texts are scanned whole; repeated rows are scanned each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The phrases of the base and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: SPDX identifier | name as a regular expression over lower-case text | address.
LICENSES = r"""
GPL-2.0 | gnu general public licen[sc]e,? (?:version|v) ?2(?:\.0)?\b | gnu.org/licenses/old-licenses/gpl-2.0
GPL-3.0 | gnu general public licen[sc]e,? (?:version|v) ?3(?:\.0)?\b | gnu.org/licenses/gpl-3.0
LGPL-2.0 | gnu library general public licen[sc]e,? (?:version|v) ?2(?:\.0)?\b | gnu.org/licenses/old-licenses/lgpl-2.0
LGPL-2.1 | gnu lesser general public licen[sc]e,? (?:version|v) ?2\.1 | gnu.org/licenses/old-licenses/lgpl-2.1
LGPL-3.0 | gnu lesser general public licen[sc]e,? (?:version|v) ?3(?:\.0)?\b | gnu.org/licenses/lgpl-3.0
AGPL-3.0 | gnu affero general public licen[sc]e(?:,? (?:version|v) ?3(?:\.0)?\b)? | gnu.org/licenses/agpl-3.0
GFDL-1.3 | gnu free documentation licen[sc]e(?:,? (?:version|v) ?1\.[0-3])? | gnu.org/licenses/fdl-1.3
Apache-1.1 | apache (?:software )?licen[sc]e,? (?:version|v) ?1\.1 | apache.org/licenses/license-1.1
Apache-2.0 | apache (?:software )?licen[sc]e,? (?:version|v) ?2(?:\.0)?\b | apache.org/licenses/license-2.0
MIT | mit licen[sc]e | opensource.org/licenses/mit
MIT-0 | mit no attribution(?: licen[sc]e)? | opensource.org/licenses/mit-0
X11 | x11 licen[sc]e | spdx.org/licenses/x11
BSD-2-Clause | (?:bsd 2-clause|simplified bsd|2-clause bsd|freebsd) licen[sc]e | opensource.org/licenses/bsd-2-clause
BSD-3-Clause | (?:bsd 3-clause|(?:new|revised|modified) bsd|3-clause bsd) licen[sc]e | opensource.org/licenses/bsd-3-clause
BSD-4-Clause | (?:bsd 4-clause|original bsd|4-clause bsd) licen[sc]e | spdx.org/licenses/bsd-4-clause
0BSD | (?:zero-clause bsd|bsd zero clause) licen[sc]e | opensource.org/licenses/0bsd
ISC | isc licen[sc]e | opensource.org/licenses/isc
Zlib | zlib(?:/libpng)? licen[sc]e | opensource.org/licenses/zlib
Libpng | libpng licen[sc]e | libpng.org/pub/png/src/libpng-license
MPL-1.0 | mozilla public licen[sc]e,? (?:version|v) ?1\.0 | mozilla.org/mpl/1.0
MPL-1.1 | mozilla public licen[sc]e,? (?:version|v) ?1\.1 | mozilla.org/mpl/1.1
MPL-2.0 | mozilla public licen[sc]e,? (?:version|v) ?2(?:\.0)?\b | mozilla.org/mpl/2.0
EPL-1.0 | eclipse public licen[sc]e(?:,? -? ?(?:version|v)? ?1\.0) | eclipse.org/legal/epl-v10
EPL-2.0 | eclipse public licen[sc]e(?:,? -? ?(?:version|v)? ?2\.0) | eclipse.org/legal/epl-2.0
EUPL-1.1 | european union public licen[sc]e,? (?:version|v)? ?\.? ?1\.1 | spdx.org/licenses/eupl-1.1
EUPL-1.2 | european union public licen[sc]e,? (?:version|v)? ?\.? ?1\.2 | spdx.org/licenses/eupl-1.2
CDDL-1.0 | common development and distribution licen[sc]e(?:,? (?:version|v)? ?1\.0)? | opensource.org/licenses/cddl-1.0
CPL-1.0 | common public licen[sc]e(?:,? (?:version|v)? ?1\.0)? | opensource.org/licenses/cpl1.0
Artistic-1.0 | artistic licen[sc]e,? (?:version|v)? ?1\.0 | opensource.org/licenses/artistic-license-1.0
Artistic-2.0 | artistic licen[sc]e,? (?:version|v)? ?2\.0 | opensource.org/licenses/artistic-license-2.0
BSL-1.0 | boost software licen[sc]e | boost.org/license_1_0
Unlicense | the unlicense | unlicense.org
WTFPL | do what the f[u*]ck you want to public licen[sc]e | wtfpl.net
CC0-1.0 | (?:cc0 1\.0|creative commons (?:zero|cc0))(?: universal)? | creativecommons.org/publicdomain/zero/1.0
PDM-1.0 | public domain mark(?: 1\.0)? | creativecommons.org/publicdomain/mark/1.0
ODbL-1.0 | (?:open data commons )?open database licen[sc]e | opendatacommons.org/licenses/odbl
PDDL-1.0 | public domain dedication (?:and|&) licen[sc]e | opendatacommons.org/licenses/pddl
ODC-By-1.0 | open data commons attribution licen[sc]e | opendatacommons.org/licenses/by
OFL-1.1 | sil open font licen[sc]e | scripts.sil.org/ofl
PostgreSQL | postgresql licen[sc]e | opensource.org/licenses/postgresql
Python-2.0 | python (?:software foundation )?licen[sc]e | docs.python.org/license
PSF-2.0 | psf licen[sc]e agreement | spdx.org/licenses/psf-2.0
Ruby | ruby licen[sc]e | ruby-lang.org/en/about/license
PHP-3.01 | php licen[sc]e | php.net/license
Perl | same terms as perl(?: 5)? itself | dev.perl.org/licenses
OpenSSL | openssl licen[sc]e | openssl.org/source/license
curl | curl licen[sc]e | curl.se/docs/copyright
NCSA | (?:university of illinois/)?ncsa open source licen[sc]e | opensource.org/licenses/ncsa
AFL-3.0 | academic free licen[sc]e | opensource.org/licenses/afl-3.0
OSL-3.0 | open software licen[sc]e | opensource.org/licenses/osl-3.0
MS-PL | microsoft public licen[sc]e | opensource.org/licenses/ms-pl
MS-RL | microsoft reciprocal licen[sc]e | opensource.org/licenses/ms-rl
APSL-2.0 | apple public source licen[sc]e | opensource.apple.com/apsl
NPL-1.1 | netscape public licen[sc]e | mozilla.org/mpl/npl
SPL-1.0 | sun public licen[sc]e | spdx.org/licenses/spl-1.0
IPL-1.0 | ibm public licen[sc]e | opensource.org/licenses/ipl-1.0
W3C | w3c software (?:notice and )?licen[sc]e | w3.org/consortium/legal
QPL-1.0 | q public licen[sc]e | opensource.org/licenses/qpl-1.0
SSPL-1.0 | server side public licen[sc]e | mongodb.com/licensing/server-side-public-license
BUSL-1.1 | business source licen[sc]e | mariadb.com/bsl11
Elastic-2.0 | elastic licen[sc]e | elastic.co/licensing/elastic-license
UPL-1.0 | universal permissive licen[sc]e | opensource.org/licenses/upl
Vim | vim licen[sc]e | vimhelp.org/uganda
LPPL-1.3c | latex project public licen[sc]e | latex-project.org/lppl
ECL-2.0 | educational community licen[sc]e | opensource.org/licenses/ecl-2.0
Ms-LPL | microsoft limited public licen[sc]e | spdx.org/licenses/ms-lpl
JSON | json licen[sc]e | json.org/license
FTL | freetype (?:project )?licen[sc]e | freetype.org/license
IJG | independent jpeg group licen[sc]e | spdx.org/licenses/ijg
Unicode-DFS | unicode(?:, inc\.)? licen[sc]e agreement | unicode.org/copyright
""".strip()

#: What a rule of each kind looks for; the higher number wins.
KINDS = {"tag": 90, "address": 80, "grant": 70, "name": 60, "family": 30}
#: Words of license names that make poor keywords, as they stand in many names or in other texts.
COMMON = {"licen", "public", "software", "general", "open", "source", "the", "you", "what", "want", "same", "terms", "free", "server", "side", "common"}

#: Keywords of the names that begin with alternatives.
EITHER = {"CC0-1.0": ("cc0", "creative commons")}


def keyword_of(regex: str) -> tuple[str, ...]:
    """The most telling word that every match of a name holds: groups, classes and escapes are left out, innermost first."""
    bare = re.sub(r"\[.*?\]|\\.", " ", regex)
    while (less := re.sub(r"\([^()]*\)\??", " ", bare)) != bare:
        bare = less
    words = re.findall(r"[a-z0-9]{3,}", bare)
    return tuple(sorted(words, key=lambda w: (w in COMMON, -len(w), w))[:1])


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    #: One of these stands in every text that the rule can match; none: the rule always runs.
    keywords: tuple[str, ...]
    regex: str


def rules() -> list[Rule]:
    """All rules in order of priority, built from the table by the kinds above."""
    out = []

    def add(label: str, kind: str, keywords: tuple[str, ...], regex: str) -> None:
        out.append(Rule(label, kind, KINDS[kind], keywords, regex))

    def four(label: str, name: str, address: str, keywords: tuple[str, ...] = ()) -> None:
        low = re.escape(label.lower())
        if not keywords:
            keywords = EITHER.get(label) or keyword_of(name)
        add(label, "tag", ("spdx-license-identifier",), rf"spdx-license-identifier:\s*\(?{low}(?:-only|-or-later|\+)?(?![\w.-])")
        add(label, "address", (address,), rf"\b{re.escape(address)}(?![\w-])")
        grant = r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"
        add(label, "grant", keywords, rf"\b{grant}(?:{name})")
        add(label, "name", keywords, rf"\b(?:{name})")

    for line in LICENSES.split("\n"):
        four(*(x.strip() for x in line.split(" | ")))
    parts = {"by": "attribution", "nc": "non-?commercial", "nd": "no-?deriv(?:s|atives)", "sa": "share-?alike"}
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            named = r"[ -]+".join(parts[p] for p in kind.split("-"))
            short = kind.replace("-", "[ -]")
            name = rf"(?:cc[ -]{short}|creative commons[ -]+{named})(?: international| unported| generic)?[ ,-]+(?:v(?:ersion)? ?)?{re.escape(version)}"
            four(f"CC-{kind.upper()}-{version}", name, f"creativecommons.org/licenses/{kind}/{version}", ("cc by", "cc-by", "creative commons"))
    for label, keywords, regex in (
        ("gpl", "gpl", r"\bgpl(?:v?[123])?\b"),
        ("gpl", "gnu general public licen", r"\bgnu general public licen[sc]e\b"),
        ("lgpl", "lgpl", r"\blgpl(?:v?[23](?:\.1)?)?\b"),
        ("agpl", "agpl", r"\bagpl(?:v?3)?\b"),
        ("apache", "apache", r"\bapache(?: software)? licen[sc]e\b"),
        ("mit", "mit", r"\bmit(?:[ -]style)? licen[sc]e\b"),
        ("bsd", "bsd", r"\bbsd(?:[ -]style)? licen[sc]e\b"),
        ("cc-by", "cc by|cc-by", r"\bcc[ -]by\b"),
        ("creative-commons", "creative commons", r"\bcreative commons\b"),
        ("public-domain", "public domain", r"\bpublic domain\b"),
        ("all-rights-reserved", "all rights reserved", r"\ball rights reserved\b"),
        ("proprietary", "proprietary and confidential", r"\bproprietary and confidential\b"),
    ):
        add(label, "family", tuple(keywords.split("|")), regex)
    return sorted(out, key=lambda r: -r.priority)


#: Separators become spaces and A-Z lower case; every other byte belongs to a word.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Scanner:
    def __init__(self, own: list[Rule]):
        self.rules = [(r, re.compile(r.regex.encode())) for r in own]
        self.always = [i for i, (r, _) in enumerate(self.rules) if not r.keywords]
        by: dict[str, list[int]] = {}
        for i, (r, _) in enumerate(self.rules):
            for k in r.keywords:
                by.setdefault(k, []).append(i)
        by.setdefault("spdx-license-identifier", [])
        self.automaton = ahocorasick.Automaton()
        for k, v in by.items():
            self.automaton.add_word(k, tuple(v))
        self.automaton.make_automaton()

    def detect(self, raw: bytes) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) by byte, with what lies within a detection of a higher place removed."""
        low = raw.translate(_LOWER)
        found = set(self.always)
        for _, which in self.automaton.iter(low.decode()):
            found.update(which)
        hits = [(r, m) for i in sorted(found) for r, rx in (self.rules[i],) for m in rx.finditer(low)]
        hits.sort(key=lambda x: (-x[0].priority, x[1].start(), -x[1].end(), x[0].label))
        taken: list[tuple[int, int, Rule]] = []
        for _, level in groupby(hits, key=lambda x: x[0].priority):
            above, reach, furthest = taken, list(accumulate((e for _, e, _ in taken), max)), -1
            starts, own = [a for a, _, _ in above], []
            for r, m in level:
                a, b = m.span()
                k = bisect_right(starts, a)
                if b > furthest and not (k and reach[k - 1] >= b):
                    own.append((a, b, r))
                    furthest = b
            taken = sorted(above + own, key=lambda x: x[:2])
        return taken


def base_places(raw: bytes) -> tuple[int, list[int], set[str]]:
    """Number of words, the word at which each phrase stands, and the labels of the phrases found."""
    words = raw.translate(_TO_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want, at, from_, word = f" {phrase} ".encode(), 0, 0, 0
        while (at := line.find(want, at)) >= 0:
            word += line.count(b" ", from_, at)
            places.append(word)
            labels.add(label)
            from_, at = at, at + 1
    return len(words), places, labels


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, detections array<struct<start:int,end:int,label:string,kind:string>>"
)


def scan(docs: DataFrame, own: list[Rule] | None = None) -> DataFrame:
    """Base counts and labels, all labels, a score, and the detections by byte offsets of the UTF-8 text."""
    own = own or rules()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("kind", pa.string())]))

    def make():
        scanner = Scanner(own)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for text in common.texts_of(batch.column("text")):
                raw = text.encode()
                n, places, base = base_places(raw)
                hits = scanner.detect(raw)
                labels = base | {r.label for _, _, r in hits}
                score = max([0.6 if base else 0.0, *(r.priority / 100 for _, _, r in hits)])
                row = (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
                row += ([{"start": a, "end": b, "label": r.label, "kind": r.kind} for a, b, r in hits],)
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

        return step

    return common.map_batches(docs.select("doc_id", "text"), "text", make, SCHEMA)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("detections")
