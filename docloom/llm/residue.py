"""Template residue and error-page text, retrieved by labelled exemplars.

Exemplars are labelled passages. An inverted index leads from a passage's terms to the exemplars it may contain: each
exemplar is posted only under its heaviest terms, as many as it takes that a passage without any of them can't reach
the threshold. TF-IDF containment, with weights from the corpus, is computed both ways on passage windows (sentences
and lines): how much of the exemplar the window holds, and how much of the window the exemplar explains.
Unfilled fields are exemplars by shape: the delimiters of template languages around a name are one term of the passage,
whose window is the field alone. The exemplars are a parameter; so is what counts as residue.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import words
from docloom.shared import cut

#: Labelled passages. The first word is the label; names of sites and pages are left out. ⟨…⟩ is a shape.
EXEMPLARS = """
script please enable javascript to view this page
script you need to enable javascript to run
script you need to enable javascript to run this app
script javascript is disabled in your browser
script turn it on and reload
script requires scripts and cookies
script your browser currently blocks them
script sorry this content can't be shown without client side scripts
script this application works best with scripting turned on
script it looks like scripting is off
script your browser is not supported
script your browser is out of date please update your browser
script upgrade it or allow scripts for this site
script if nothing happens scripts may be blocked
script bitte aktivieren sie javascript um diese seite anzuzeigen
script veuillez activer javascript pour afficher ce contenu
script active javascript en su navegador para continuar
script для просмотра страницы включите javascript
script ihr browser wird nicht unterstützt
script votre navigateur n'est pas pris en charge
script su navegador no es compatible
script ваш браузер не поддерживается
loading loading
loading loading please wait
loading checking your browser before accessing example
loading this process is automatic
loading just a moment
loading are you a robot
loading verify you are human
block access denied
block you don't have permission to view this resource on example
block you don't have permission to access this resource
block too many requests
block you have been rate limited retry after 0 seconds
block session expired
block please sign in again to continue to
block zugriff verweigert
block accès refusé
block acceso denegado
block доступ запрещён
error 404 not found
error 403 forbidden
error 500 internal server error
error 502 bad gateway
error 503 service unavailable
error 504 gateway timeout
error error 404 page not found
error error 503 service unavailable
error internal server error
error something went wrong on our side
error the server is temporarily unable to handle the request
error the requested page could not be located on this server
error we can't find that page
error oops we can't find that page
error it may have moved
error go back to or try searching
error this site can't be reached
error example took too long to respond
error fatal error template missing
error warning failed to open stream no such file in srv policy tpl on line 0
error seite nicht gefunden
error die angeforderte adresse existiert nicht mehr
error página no encontrada
error el enlace a está roto o caducó
error page introuvable
error erreur 403 accès refusé
error erreur 404 page introuvable
error ошибка 404 страница не найдена
error страница не найдена
filler this is dummy copy for layout purposes
filler this is dummy text
filler placeholder block
filler placeholder text
filler body copy body copy body copy body copy
filler heading one
filler title of section
filler subtitle of section
filler description of section
filler short description goes here
filler your text goes here
filler text goes here
filler content goes here
filler click here to edit
filler click to edit this text
filler insert text here
filler text to be supplied by the legal team
filler replace this paragraph before publishing
filler add a description of your policy
filler your content will appear in this area
filler texte provisoire à remplacer
filler item a
filler item b
filler item c
filler tbd
filler to be determined
filler todo
filler coming soon
filler hier steht später der eigentliche text
filler hier kommt der text
filler ici viendra le texte
filler texto de ejemplo
filler здесь будет текст документа
error sorry the page you were looking for does not exist
error the page you are looking for doesn't exist
error the page you requested could not be found
error 400 bad request
error 401 unauthorized
error 405 method not allowed
error 408 request timeout
error 410 gone
block 429 too many requests
script javascript must be turned on for this website to work
script javascript is required to use this site
script please turn on javascript
field ⟨double_brace⟩
field ⟨brace_percent⟩
field ⟨dollar_brace⟩
field ⟨brace_dollar⟩
field ⟨double_bracket⟩
field ⟨double_angle⟩
field ⟨angle_percent⟩
field ⟨double_at⟩
field ⟨double_underscore⟩
field ⟨percent⟩
field ⟨hash⟩
field ⟨angle_capitals⟩
field ⟨brace_camel⟩
field ⟨brace_snake⟩
field ⟨bracket_order⟩
field ⟨bracket_capitals⟩
field ⟨bracket_dots⟩
field ⟨crosses⟩
field ⟨to_do⟩
field ⟨parenthesis_order⟩
field ⟨blank⟩
"""
#: The shapes of fields, a name and what a field of this shape looks like.
SHAPES = r"""
double_brace \{\{\s*[\w .-]+\s*\}\}
brace_percent \{%\s*\w+\s*%\}
dollar_brace \$\{\s*[\w.]+\s*\}
brace_dollar \{\$\w+\}
double_bracket \[\[\s*\w+\s*\]\]
double_angle <<\s*\w+(?: \w+){0,4}\s*>>
angle_percent <%=?\s*\w+\s*%>
double_at @@\w+@@
double_underscore (?<![A-Za-z0-9_])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![A-Za-z0-9_])
percent %[A-Za-z]+(?:_[A-Za-z]+)*%
hash \#[A-Za-z]+(?:_[A-Za-z]+)*\#
angle_capitals <[A-Z]+(?:[_ ][A-Z]+)*>
brace_camel \{[A-Za-z]*[A-Z][A-Za-z]*\}
brace_snake \{[a-z]+(?:_[a-z]+)+\}
bracket_order \[(?i:insert|enter|your|add)\b[^\[\]\n]{0,60}\]
bracket_capitals \[[A-Z]{2,}(?:[ _][A-Z]+)*\]
bracket_dots \[[●•_…. ]+\]
crosses \bX{3,}\ ?\([^()\n]{1,60}\)
to_do \b(?:TODO|FIXME|TBD|TBC)\b:|[\[(](?:TODO|FIXME|TBD|TBC)[\])]
parenthesis_order \((?i:enter|insert|add)\ (?:the\ |your\ )?[a-z ]{1,40}\)
blank _{5,}\ ?\([^()\n]{1,60}\)
"""
#: Bags of filler words (the printers' Latin, keyboard mashing); a window made of them is a match.
FILLER_BAGS = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure
dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat
non proident sunt in culpa qui officia deserunt mollit anim id est laborum
pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas vestibulum tortor quam feugiat
vitae ultricies eget tempor sit amet ante donec eu libero sit amet quam egestas semper aenean ultricies mi vitae est mauris
foo bar baz qux blah asdf qwer qwerty test aaa bbb xxx yyy zzz
"""
#: Words of the second bag that real text uses alone.
MASH = ("foo", "bar", "baz", "qux", "blah", "asdf", "qwer", "qwerty", "test", "aaa", "bbb", "xxx", "yyy", "zzz")

_CODE = re.compile(r"(?<!`)(`+)(?!`)[^\n]+?(?<!`)\1(?!`)")
_FIELD = re.compile("|".join("(?P<%s>%s)" % tuple(line.split(" ", 1)) for line in SHAPES.strip().split("\n")))
#: What any field has; quick to look for.
_FIELD_MARK = re.compile(r"[{\[<%@#]|__|\((?i:enter|insert|add)|XXX|TODO|FIXME|TBD|TBC")
_PASSAGE = re.compile(r"(?<=[.!?…])\s+|[\n\r\x0b\x0c\x1c-\x1e\x85  ]+")

#: Share of an exemplar's weight that a window must hold.
CONTAINMENT = 0.8
#: Share of a window's weight that the exemplar must explain.
COVERAGE = 0.6


def labelled(exemplars: str = EXEMPLARS) -> list[tuple[str, list[str]]]:
    """(label, terms) of the exemplars, one per line; a shape is a single term."""
    rows = [line.split(" ", 1) for line in exemplars.strip().split("\n") if " " in line]
    return [(label, [text] if text[0] == "⟨" else words(text)) for label, text in rows]


class Index:
    """Inverted index over the exemplars for given corpus counts (term -> records that hold it) of ``n`` records."""

    def __init__(self, df: dict[str, int], n: int, exemplars: str = EXEMPLARS) -> None:
        self.n = max(n, 1)
        self.df = df
        self.labels: list[str] = []
        self.terms: list[frozenset[str]] = []
        self.total: list[float] = []
        self.posting: dict[str, list[int]] = {}
        for label, found in labelled(exemplars):
            terms = sorted(set(found), key=lambda t: (-self.weight(t), t))
            total = sum(map(self.weight, terms))
            held = 0.0
            for t in terms:  # without these the containment can't be reached
                self.posting.setdefault(t, []).append(len(self.terms))
                held += self.weight(t)
                if total - held < CONTAINMENT * total:
                    break
            self.labels.append(label)
            self.terms.append(frozenset(terms))
            self.total.append(total)
        self.filler = frozenset(words(FILLER_BAGS))
        #: Of a term whose count isn't at hand: some record holds it, and all may.
        self.least = 0.1
        self.most = math.log((self.n + 1) / (min(1, self.n) + 1)) + 0.1

    def weight(self, term: str) -> float:
        return math.log((self.n + 1) / (min(self.df.get(term, 0), self.n) + 1)) + 0.1

    def candidates(self, text: str, every: bool = False) -> tuple[tuple[str, float] | None, list[tuple[str, float, float, list[str]]]]:
        """The best match that holds whatever the counts of terms outside ``df`` are, and those that hang on them: label,
        containment, room (what such terms may weigh) and these terms. With ``every``, ``df`` has the counts of all terms."""
        plain = _CODE.sub(" ", text) if "`" in text else text
        if _FIELD_MARK.search(plain):
            for m in _FIELD.finditer(plain):
                for e in self.posting.get(f"⟨{m.lastgroup}⟩", ()):  # the window is the field: held and explained whole
                    return (self.labels[e], 1.0), []
        of_text = words(text)
        near = self.posting.keys() & of_text
        if not near and sum(w in self.filler for w in of_text) < 4:  # a window of filler has four such words at least
            return None, []
        best, unsure = None, []
        for passage in _PASSAGE.split(plain):
            of = words(passage)
            if len(of) >= 4 and sum(w in self.filler for w in of) >= CONTAINMENT * len(of):
                if (held := set(of)) & set(MASH) or len(held - {"in", "id", "non", "ex", "ad", "do", "et", "est", "qui", "sit", "sed", "ut", "eu", "ea", "sint"}) >= 3:
                    best = max(best or ("", 0.0), ("filler", 1.0), key=lambda b: b[1])
            window = set(of)
            for e in sorted({e for t in window & near for e in self.posting[t]}):
                both = sum(map(self.weight, self.terms[e] & window))
                if both < CONTAINMENT * self.total[e]:
                    continue
                rest = sorted(window - self.terms[e])
                unknown = [] if every else [t for t in rest if t not in self.df]
                room = both / COVERAGE - both - sum(self.weight(t) for t in rest if every or t in self.df)
                score = both / self.total[e]
                if room >= self.most * len(unknown):
                    if best is None or score > best[1]:
                        best = (self.labels[e], score)
                elif room >= self.least * len(unknown):
                    unsure.append((self.labels[e], score, room, unknown))
        return best, [u for u in unsure if best is None or u[1] > best[1]]

    def match(self, text: str) -> tuple[str, float] | None:
        """Label and containment of the best match of a text, or None, with ``df`` as the counts of all terms."""
        return self.candidates(text, every=True)[0]


#: Terms a worker counts before it hands the counts on.
COUNTED_TERMS = 200_000


def document_counts(texts: DataFrame) -> DataFrame:
    """``term, n``: the records that hold each term, over all texts; the null term has the number of records."""

    def rows(seen, records):
        return pa.RecordBatch.from_arrays(
            [pa.array([*seen, None], pa.string()), pa.array([*seen.values(), records], pa.int64())], names=["term", "n"]
        )

    def count(batches):
        seen, records = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                records += 1
                seen.update(set(words(text)))
                if len(seen) >= COUNTED_TERMS:
                    yield rows(seen, records)
                    seen, records = Counter(), 0
        yield rows(seen, records)

    return texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def exemplar_counts(counts: DataFrame, exemplars: str = EXEMPLARS) -> tuple[dict[str, int], int]:
    """Records that hold each exemplar term, and the number of records, from the counts of all terms. The result is as long
    as the exemplars have terms, however large the corpus is."""
    vocabulary = sorted({t for _, terms in labelled(exemplars) for t in terms})
    rows = {r.term: r.n for r in counts.filter(F.col("term").isNull() | F.col("term").isin(vocabulary)).collect()}
    n = rows.pop(None, 0) or 0
    return {t: rows.get(t, 0) for t in vocabulary}, n


_FOUND = "key string, doc_id long, label string, score double, unsure array<struct<label: string, score: double, room: double, terms: array<string>>>"
_UNSURE = pa.list_(
    pa.struct([("label", pa.string()), ("score", pa.float64()), ("room", pa.float64()), ("terms", pa.list_(pa.string()))])
)


def residue(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", exemplars: str = EXEMPLARS) -> DataFrame:
    """``doc_id, label, score`` of every record with residue; label: field, script, loading, block, error or filler.

    Null or empty texts have none; a repeated row is reported again; an empty table gives no rows. Only the two named
    columns are read. ``exemplars``: labelled passages, one per line. Matches that hang on the weights of words no exemplar has are joined with the counts of these.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    terms = cut(document_counts(texts.select("text")), "terms")
    counts, n = exemplar_counts(terms, exemplars)

    def find(batches):
        index = Index(counts, n, exemplars)
        for batch in batches:
            out = ([], [], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                best, unsure = index.candidates(text)
                if best or unsure:
                    open_ = [dict(zip(("label", "score", "room", "terms"), u)) for u in unsure]
                    for column, value in zip(out, (uuid.uuid4().hex, key, *(best or (None, None)), open_)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.float64()), pa.array(out[4], _UNSURE)],
                names=["key", "doc_id", "label", "score", "unsure"],
            )

    found = cut(texts.mapInArrow(find, _FOUND), "found")
    weight = F.log(F.lit(n + 1.0) / (F.least(F.coalesce("n", F.lit(1)), F.lit(n)) + 1)) + 0.1
    unsure = found.select("key", F.posexplode("unsure").alias("at", "u")).select("key", "at", "u.*")
    settled = (
        unsure.select("key", "at", "label", "score", "room", F.explode("terms").alias("term")).join(terms, "term", "left")
        .groupBy("key", "at", "label", "score", "room").agg(F.sum(weight).alias("rest")).filter("rest <= room")
        .groupBy("key").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("at"))).alias("u"))
    )
    return found.join(settled, "key", "left").filter("label is not null or u is not null").select(
        "doc_id", F.coalesce("u.label", "label").alias("label"), F.coalesce("u.score", "score").alias("score")
    )


def without_residue(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", exemplars: str = EXEMPLARS) -> DataFrame:
    """The records without residue, all columns kept; records with a null id stay."""
    found = residue(docs, id_col=id_col, text_col=text_col, exemplars=exemplars).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col("_hit"), "left_anti")
