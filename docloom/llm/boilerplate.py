"""Page boilerplate mixed with main content: wrappers inferred by aligning the token streams of one site's pages.

Every page becomes a stream of its lines, in which the site's name, numbers and addresses are slots. The pages of a site
are aligned one after the other with the wrapper found so far, in blocks of bounded size: a line that only one side has
becomes optional, one that recurs within a page repeated; words in which lines of equal shape differ become text slots,
titles of the site's pages one named slot, and lines that no other page shares are the text slot between the elements.
The result is a regular expression without unions.

A menu and a standing clause both recur; what tells them apart is where the wrapper holds them. A template's lines stand
between the text slot and the page's edge, or in runs of other lines of the template; a clause stands within the text.
So every element gets a score, how firmly its neighbours in the aligned pages belong to the template, and support and
score, summed over the site, decide. Exemplars of menus, notices and footers only break ties: they decide where an element
has too few pages or its score lies between.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import hash_text
from docloom.llm.markup import header_end, mask
from docloom.shared import cut, small_side

#: Pages aligned at a time; a site with more is split into blocks, whose elements are added up over the site.
BLOCK_PAGES = 256
#: Words up to which a line is compared word by word; a longer one is an element as a whole.
LINE_WORDS = 24
#: Pages of different titles of a site that must share an element before the wrapper decides on it.
MIN_SUPPORT = 4
#: Score from which an element belongs to the template; with slots, which match by chance, more is asked of few pages.
CHROME_SCORE = 0.55
SLOT_MARGIN = 1.2
#: Pages from which, and score below which, an element belongs to the text whatever an exemplar says.
OWN_SUPPORT = 20
OWN_SCORE = 0.3
#: Rounds in which scores pass from an element to its neighbours.
ROUNDS = 2
#: A word is a text slot if at most one of so many pages of a site holds it.
RARE_PAGES = 20
#: A title's form counts if more than one of so many pages of a site has it.
RARE_TITLES = 200
#: Words a worker counts before it hands the counts on.
COUNTED_WORDS = 200_000
#: Words of a line up to which shape alone (a comment, a quotation) can make it known.
SHAPE_WORDS = 24

#: Entries of menus in five languages.
NAV = """
home|menu|status|support|products|pricing|careers|press|blog|safety|partners|download|sign up|log in|about|contact|help
startseite|blog|preise|produkte|karriere|presse|sicherheit|registrieren|anmelden|hilfe|über uns|kontakt|partner
accueil|blog|tarifs|produits|carrières|sécurité|connexion|inscription|aide|presse|contact|partenaires
inicio|precios|productos|blog|registro|entrar|ayuda|prensa|seguridad|empleo|contacto|socios
главная|блог|цены|продукты|вакансии|безопасность|войти|регистрация|помощь|пресса|контакты|партнёры
"""
#: Exemplar lines. § is the site's name, 0 a number, … any words; one alternative per line.
EXEMPLARS = """
skip to content
zum inhalt springen
aller au contenu
saltar al contenido
перейти к содержанию
follow § on every channel…
folgen sie § auf allen kanälen…
suivez § sur tous les canaux…
siga a § en todos los canales…
следите за § во всех каналах…
download the § app…
laden sie die app von § herunter…
téléchargez l'application de §…
descargue la aplicación de §…
скачайте приложение §…
§ is a registered mark…
§ ist eine eingetragene marke…
§ est une marque déposée…
§ es una marca registrada…
§ является зарегистрированным знаком…
© 0 §…
change country or language for §
land oder sprache für § ändern
made with care by…
gestaltet vom…
subscribe to the § newsletter…
abonnieren sie jetzt den rundbrief…
abonnez-vous à la lettre…
suscríbase al boletín…
подпишитесь сегодня на рассылку…
log in to leave a comment…
melden sie sich an, um zu kommentieren…
was this article helpful…
war dieser artikel hilfreich…
cet article vous a-t-il aidé…
¿le resultó útil este artículo…
была ли статья полезна…
0 people found this page helpful
0 personen fanden diese seite hilfreich
0 personnes ont trouvé cette page utile
0 personas hallaron útil esta página
0 человек сочли эту страницу полезной
share this page with…
teilen sie diese seite…
partagez cette page…
comparta esta página…
поделитесь этой страницей…
send us feedback about…
print this page…
reading time: …
lesezeit: …
temps de lecture : …
tiempo de lectura: …
время чтения: …
tags: …
schlagwörter: …
mots-clés : …
etiquetas: …
метки: …
you may also like
more from §
mehr von §
plus de §
más de §
ещё от §
on this page
auf dieser seite
sur cette page
en esta página
на этой странице
related articles
verwandte artikel
articles liés
artículos relacionados
похожие статьи
accept cookies
got it!
verstanden!
compris !
¡entendido!
понятно!
cookie settings · agree and close
only necessary | allow all
nur notwendige | alle erlauben
accept all | reject…
alle akzeptieren | ablehnen…
tout accepter | refuser…
aceptar todo | rechazar…
принять все | отклонить…
gérer mes choix
gestionar opciones
настроить выбор
auswahl verwalten
this site stores small files…
diese website speichert kleine dateien…
ce site dépose de petits fichiers…
este sitio guarda pequeños archivos…
этот сайт хранит небольшие файлы…
§ and its partners would like your permission…
§ bittet um ihre zustimmung…
§ demande votre accord…
§ pide su permiso…
§ solicita su permiso…
§ просит вашего согласия…
your choice matters: cookies help §…
we use cookies and similar tools…
wir verwenden cookies, um…
nous utilisons des cookies pour…
usamos cookies para…
мы используем куки, чтобы…
by continuing to browse § you agree…
privacy · terms · imprint · sitemap of §
impressum · datenschutz · agb · §
mentions légales · confidentialité · plan · §
aviso legal · privacidad · mapa · §
правила · данные · карта сайта · §
"""
#: Titles of policies; * is the policy's own name.
TITLES = """
privacy notice for *|* terms of use|community rules of *|* cookie statement|acceptable use of *|developer agreement for *|* data policy
datenschutzhinweise für *|nutzungsbedingungen von *|gemeinschaftsregeln *|cookie-erklärung *|zulässige nutzung von *|entwicklervertrag *|datenrichtlinie *
avis de confidentialité de *|conditions d'utilisation de *|règles de la communauté *|déclaration cookies *|usage acceptable de *|contrat développeur *|politique de données *
aviso de privacidad de *|condiciones de uso de *|normas de la comunidad *|declaración de cookies *|uso aceptable de *|acuerdo de desarrollo *|política de datos *
уведомление о данных *|условия сервиса *|правила сообщества *|заявление о куки *|допустимое использование *|договор разработчика *|политика данных *
"""

_NAV = frozenset(x for line in NAV.strip().split("\n") for x in line.split("|"))
_NAV_STARTS = frozenset(x.split(" ")[0] for x in _NAV) | {"§"}
_SEPARATORS = frozenset("|·•/»>›→-")
_TITLES = frozenset(x for line in TITLES.strip().split("\n") for x in line.split("|"))


def _pattern(line: str) -> str:
    return re.escape(line).replace("…", ".*").replace(r"\.\*", ".*")


_KNOWN = frozenset(x for x in EXEMPLARS.strip().split("\n") if "…" not in x)
#: First word -> patterns of the exemplars with an open end.
_OPEN: dict[str, re.Pattern] = {}
for _first in {x.split(" ")[0] for x in EXEMPLARS.strip().split("\n") if "…" in x}:
    _OPEN[_first] = re.compile(
        "|".join(_pattern(x) for x in EXEMPLARS.strip().split("\n") if "…" in x and x.split(" ")[0] == _first)
    )
#: How notes of the page's own keepers begin; they recur but belong to the text.
_NOTES = ("document owner", "dokumentverantwortung", "responsable du document", "responsable del documento", "владелец документа",
          "reviewed by", "geprüft von", "relu par", "revisado por", "проверено", "version", "revision")

_DECOR = re.compile(r"^(?:[#>]+\s*|[-*+•]\s+|\d+[.)]\s+)+")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]*)\]\([^()\n]*\)")
_URL = re.compile(r"https?://\S+")
_NUMBER = re.compile(r"\d+")
_MARKS = re.compile(r"[|·•/»>›→]")
_CRUMB = re.compile(r"\s+(?:>|»|/|›|→)\s+")
_COMMENT_LINE = re.compile(r"[\w.-]*_?\d+ ?: \S|[\w-]+ (?:wrote|schrieb|a écrit|escribió|написал[аи]?) ?:")
_ODD = re.compile(r"[*_'<\\{$`=&]")
_SENTENCE = re.compile(r"[.!?:;…][\"”»)]*$")
_TAGS = re.compile(r"[\w-]+(?: · [\w-]+){2,}")
_OWN_MARK = re.compile(r"^\s*(?:<|\\|\{\||\|[-}|]|\|.*\|\||!\[|\[\[|\$\$|\[\^|==|'')|^\s*\[[^\]]+\]:")


#: Labels that stand before a country's own domain and name no site.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ne", "net", "nom", "or", "org", "sch")
_HOST = r"^\s*(?:[A-Za-z][\w+.-]*://)?(?:[^/@\s]*@)?([^/:?#\s]+)"
_IP = r"^\d+(?:\.\d+){3}$"


def site_of(url: str | None) -> str | None:
    """The label that names a site: the last but one of the host's labels, or the one before it where that is a
    country's second level (``co.uk``); an IP address as it is; null for no address."""
    m = re.match(_HOST, url or "")
    host = m.group(1).lower().rstrip(".") if m else ""
    if re.match(_IP, host):
        return host
    labels = host.split(".")
    if len(labels) >= 3 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL:
        return labels[-3]
    return labels[-2] if len(labels) >= 2 else (labels[0] or None)


def site_column(url: Column | str) -> Column:
    """:func:`site_of` as an expression."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    labels = F.split(host, r"\.", -1)
    second = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL)
    return (
        F.when(host.rlike(_IP), host).when(second, F.try_element_at(labels, F.lit(-3)))
        .when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(F.nullif(labels[0], F.lit("")))
    )


def _own_name(url: str | None) -> str:
    path = re.sub(r"[?#].*$", "", (url or "").strip()).rstrip("/_ ").rsplit("/", 1)
    return path[-1].lower() if len(path) == 2 else ""


def _is_title(words: list[str], titles: frozenset[str] | set[str] = _TITLES) -> bool:
    """Is the line a title pattern with one word in the place of the name?"""
    for i in range(len(words)):
        if " ".join(words[:i] + ["*"] + words[i + 1 :]) in titles:
            return True
    return False


def _all_nav(words: list[str]) -> bool:
    """Does the line consist of menu entries, of two words or one, and nothing else?"""
    i = 0
    while i < len(words):
        if " ".join(words[i : i + 2]) in _NAV:
            i += 2
        elif words[i] in _NAV:
            i += 1
        else:
            return False
    return True


_SITES: dict[str, re.Pattern] = {}


def _site_pattern(site: str) -> re.Pattern | None:
    """The site's name as whole words; None for a name too short to tell from a word."""
    if len(site) < 3:
        return None
    if site not in _SITES:
        if len(_SITES) > 50_000:
            _SITES.clear()
        _SITES[site] = re.compile(r"(?<!\w)" + r"(?:[^\S\n]|[_-])+".join(map(re.escape, re.split(r"[-_]+", site))) + r"(?!\w)")
    return _SITES[site]


def header_url(text: str | None) -> str | None:
    """The first address in the page's header."""
    for line in (text or "").split("\n")[: header_end(text or "")]:
        if m := re.search(r"https?://[^\s_]+\S*", line):
            return m.group()
    return None


def _known(low: str, words: list[str], linked: bool, own: str) -> bool:
    """Does an exemplar or a rule of shape (links, tags, crumbs, quotations, comments) know the line?"""
    opening = _OPEN.get(words[0])
    if linked or low in _KNOWN or low in _NAV or opening and opening.match(low):
        return True
    if low[0] == "«" or low[-1] == "»":
        return low[0] == "«" and low[-1] == "»" or len(words) <= SHAPE_WORDS
    if low.endswith((" ...", " …")) and ": " in low:
        return True
    if len(words) <= SHAPE_WORDS and _COMMENT_LINE.match(low):
        return True
    if words[0] in _NAV_STARTS and _all_nav([w for w in words if w not in _SEPARATORS and w != "§"]):
        return True
    if _TAGS.fullmatch(low):
        return True
    if low[-1] != "." and _MARKS.search(low) and len(crumbs := _CRUMB.split(low)) >= 3:
        return "§" in crumbs or crumbs[0] in _NAV or bool(own) and own in crumbs[-1]
    return False


def line_stream(text: str, url: str | None, site: str | None) -> list[tuple[int, str | None, int, bool]]:
    """(line number, normalised line, label, heading) of the page's lines, the title first as number 0.

    label 1: an exemplar knows it, 2: shaped like a title, 0: unknown. A line without comparable text (code, comments, the
    text's own markup) has no normalised line and is part of the text slot. Lines of any length are read whole; one of
    more than LINE_WORDS words is represented by its hash.
    """
    end = header_end(text)
    normal = _NUMBER.sub("0", text.lower())
    if site and (name := _site_pattern(site)):
        normal = name.sub("§", normal)
    lines = normal.split("\n")
    plain = mask(text).split("\n") if "```" in text or "~~~" in text or "$$" in text else lines
    own = _own_name(url)
    out: list[tuple[int, str | None, int, bool]] = []
    comment = False
    titled = False
    for n, (line, shown) in enumerate(zip(lines, plain), 1):
        if not line or n <= end and titled or not (body := line.strip()):
            continue
        if n <= end:
            titled = True
            title = _DECOR.sub("", text.split("\n", n)[n - 1].strip()).lower()
            out.append((0, " ".join(title.split()) or None, 0, True))  # with its numbers: a second part isn't a copy
            continue
        heading = False
        if not body[0].isalpha():
            stripped = body
            body = _DECOR.sub("", stripped)
            heading = "#" in stripped[: len(stripped) - len(body)] or body[:1] in "*_" and body[-1:] in "*_"
        linked = False
        if "<!--" in line or comment:
            comment = "-->" not in line.rpartition("<!--")[2]
            body = ""
        elif not shown or body.startswith("![") or shown.isspace():
            body = ""
        elif "](" in body:
            linked = not _LINK.sub("", body).strip(" |·•/>»,-")
            body = _LINK.sub(r"\1", body) if not linked else " | ".join(_LINK.findall(body))
        elif not body[:1].isalnum() and _OWN_MARK.match(body):
            body = ""
        if "://" in body:
            body = _URL.sub("", body)
        words = body.split()
        if not words:
            out.append((n, None, 0, heading))
            continue
        low = " ".join(words)
        label = 1 if _known(low, words, linked, own) else 0
        if not label and not heading and len(words) <= 8 and _is_title(words):
            label = 2
        if linked:
            low = "[] " + low
        elif len(words) > LINE_WORDS and not low.endswith(("...", "…")):
            low = f"#{hash_text(low):x}"
        out.append((n, low, label, heading))
    return out


_TOKEN = re.compile(r"\w+|[^\w\s]")


def _title(stream) -> str | None:
    """The title as a line that names it would have it."""
    return _NUMBER.sub("0", stream[0][1]) if stream and stream[0][0] == 0 and stream[0][1] else None


def _words(stream) -> set[str]:
    """The words of a stream's title and lines; a long line's hash isn't one."""
    lows = [low for n, low, _, _ in stream if n and low and low[0] != "#"]
    return set(_TOKEN.findall("\n".join([*lows, _title(stream) or ""])))


def fixed_words(streams) -> set[str]:
    """The words of a site's streams that aren't slots."""
    df = Counter(w for s in streams for w in _words(s))
    return {w for w, n in df.items() if n > max(1, len(streams) // RARE_PAGES)}


def _slotted(low: str, fixed: set[str]) -> list[str]:
    """The tokens of a line, those that few pages hold as slots; slots in a row are one."""
    out: list[str] = []
    for w in _TOKEN.findall(low):
        if w in fixed:
            out.append(w)
        elif not out or out[-1] != "*":
            out.append("*")
    return out


_FIXED = re.compile(r"[^\W0_]|[§¤#]")


def solid(element: str) -> bool:
    """Does an element hold more of the template than slots?"""
    if "*" not in element:
        return _FIXED.search(element) is not None
    parts = element.split(" ")
    words = sum(p in "§¤" or p[0].isalnum() and p != "0" for p in parts)
    return element[0] == "#" or parts[0] == "[" or "¤" in parts or words > 0 and parts.count("*") <= words


def title_forms(streams, fixed: set[str]) -> Counter:
    """How many streams have a title of each form."""
    return Counter(
        form for title in map(_title, streams) if title for form in [" ".join(_slotted(title, fixed))] if solid(form)
    )


def common_titles(streams, fixed: set[str]) -> list[str]:
    return [t for t, n in title_forms(streams, fixed).items() if n > max(1, len(streams) // RARE_TITLES)]


def shape(streams, fixed: set[str], titles: list[str]) -> list[list[tuple[int, str | None, int]]]:
    """(line number, element, label) of the lines of each stream: rare words are slots (*), a title of one of the site's
    pages is the slot ¤, and so is what a teaser says behind it."""
    longest = sorted(titles, key=lambda t: (-len(t), t))
    known: dict[tuple[str, bool], str] = {}

    def element(low: str, heading: bool) -> str:
        if low[0] == "#":
            return low
        s = f" {' '.join(_slotted(low, fixed))} "
        for t in longest:
            s = s.replace(f" {t} ", " ¤ ")
        parts = s.split()
        if "¤" in parts and (parts[-1] == "…" or parts[-3:] == [".", ".", "."]):
            return " ".join(parts[: parts.index("¤") + 2]) + " … ."
        if heading and parts == ["¤"]:
            return "# ¤"
        return s.strip() if solid(s.strip()) else low  # nothing but slots: the line as it is

    out = []
    for s in streams:
        rows = []
        for n, low, label, heading in s:
            if n == 0:
                continue
            if low is not None and (low, heading) not in known:
                known[low, heading] = element(low, heading)
            rows.append((n, known[low, heading] if low is not None else None, label))
        out.append(rows)
    return out


class Wrapper:
    """The wrapper of a block of pages: elements in order, with support (titles of pages), optional and repeated."""

    def __init__(self) -> None:
        self.order: list[str] = []
        self.place: dict[str, int] = {}
        self.repeated: set[str] = set()
        self.support: Counter = Counter()

    def aligned(self, stream: list[str | None]) -> set[str]:
        """The elements of a stream that keep the wrapper's order: the longest increasing run of places."""
        tails: list[int] = []
        last: list[int] = []
        before: list[int] = []
        keys = [k for k in dict.fromkeys(stream) if k in self.place]
        for i, k in enumerate(keys):
            at = bisect_left(tails, self.place[k])
            tails[at : at + 1] = [self.place[k]]
            last[at : at + 1] = [i]
            before.append(last[at - 1] if at else -1)
        out, i = set(), last[-1] if last else -1
        while i >= 0:
            out.add(keys[i])
            i = before[i]
        return out

    def add(self, stream: list[str | None]) -> None:
        """Align one page: what the wrapper lacks goes in behind its aligned predecessor as an optional element."""
        seen: set[str] = set()
        for k in stream:
            if k in seen:
                self.repeated.add(k)
            elif k is not None and k != "*" and self.support[k] > 1:
                seen.add(k)
        if all(k in self.place for k in seen):
            return
        kept = self.aligned(stream)
        after: str | None = None
        insert: dict[str | None, list[str]] = {}
        for k in dict.fromkeys(stream):
            if k in seen and k not in self.place:
                insert.setdefault(after, []).append(k)
            elif k in kept:
                after = k
        grown = insert.get(None, [])
        for k in self.order:
            grown.append(k)
            grown += insert.get(k, ())
        self.order = grown
        self.place = {k: i for i, k in enumerate(grown)}


def owners(streams) -> list[object]:
    """Whose text a stream is: pages of one title are versions of one text and support an element once."""
    return [s[0][1] if s and s[0][0] == 0 and s[0][1] else i for i, s in enumerate(streams)]


def infer_wrapper(shaped, owner: list[object]) -> Wrapper:
    """Align the pages of a block one after the other. What no other text of the block shares is text slot."""
    wrapper = Wrapper()
    wrapper.support = Counter(k for k, _ in {(k, o) for s, o in zip(shaped, owner) for _, k, _ in s if k})
    for s in shaped:
        wrapper.add([k for _, k, _ in s])
    return wrapper


def element_scores(shaped, wrapper: Wrapper) -> dict[str, tuple[float, int]]:
    """(sum, lines) per element, whose ratio is its score: 1 if it stands at a page's edge or beside elements that do.

    At first the lines before the first and behind the last text slot of a page count, then each line has the higher
    score of its two neighbours, where a page's edge has 1 and a text slot 0. Sums and lines add up over blocks.
    """
    template = {k for k in wrapper.place if wrapper.support[k] >= MIN_SUPPORT}
    outer: Counter = Counter()
    pages: Counter = Counter()
    for s in shaped:
        keys = [k for _, k, _ in s]
        pages.update(set(keys))
        slots = [i for i, k in enumerate(keys) if k not in template]
        if slots:  # a page without a text slot doesn't show where the text is
            outer.update({k for i, k in enumerate(keys) if k and (i <= slots[0] or i >= slots[-1])})
    score = {k: outer[k] / pages[k] for k in wrapper.place}
    ids = {k: i for i, k in enumerate(dict.fromkeys(k for s in shaped for _, k, _ in s))}
    if not ids:
        return {}
    flat = np.fromiter((i for s in shaped for i in (-1, *(ids[k] for _, k, _ in s), -2)), dtype=np.int64)
    at = np.flatnonzero(flat >= 0)
    lines = np.bincount(flat[at], minlength=len(ids))
    passed = np.array([score.get(k, 0.0) for k in ids])
    within = np.array([k in wrapper.place for k in ids])
    total = np.zeros(len(ids))
    for _ in range(ROUNDS):
        near = np.where(flat < 0, 1.0, passed[flat])
        total = np.bincount(flat[at], np.maximum(near[at - 1], near[at + 1]), minlength=len(ids))
        passed = np.where(within, total / np.maximum(lines, 1), 0.0)
    return {k: (float(total[i]), int(lines[i])) for k, i in ids.items() if k is not None and k != "*"}


def verdict(element: str, support: int, score: float) -> bool | None:
    """Is an element of a site's wrapper boilerplate? None: the wrapper doesn't decide."""
    bar = CHROME_SCORE + (SLOT_MARGIN / math.sqrt(support) if "*" in element else 0)
    if solid(element) and support >= MIN_SUPPORT and score >= bar:
        return True
    return False if support >= OWN_SUPPORT and score < OWN_SCORE else None


#: A stream as three arrays: line numbers, normalised lines, and label plus 4 for a heading.
_STREAM = "n array<int>, low array<string>, flag array<tinyint>"


def site_streams(pages: DataFrame, manifest: DataFrame, text_col: str = "markdown") -> DataFrame:
    """``doc_id, site, body`` and the stream of a page, one row per ``doc_id``: ``body`` is the stream's hash; the site comes from the manifest's address
    or, where that is missing, from the page's own header."""

    def streams(batches):
        for batch in batches:
            sites, ends, n, low, flag = [], [0], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                url = header_url(text)
                site = site_of(url)
                sites.append(site)
                for number, line, label, heading in line_stream(text or "", url, site):
                    n.append(number)
                    low.append(line)
                    flag.append(label + 4 * heading)
                ends.append(len(n))
            offsets = pa.array(ends, pa.int32())
            arrays = (pa.array(n, pa.int32()), pa.array(low, pa.string()), pa.array(flag, pa.int8()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sites, pa.string()), *(pa.ListArray.from_arrays(offsets, a) for a in arrays)],
                names=["doc_id", "header_site", "n", "low", "flag"],
            )

    sites = (
        manifest.filter("doc_id is not null and url is not null").select("doc_id", site_column("url").alias("site"))
        .groupBy("doc_id").agg(F.max("site").alias("site"))
    )
    streams_df = (
        pages.filter("doc_id is not null").select("doc_id", F.col(text_col).cast("string"))
        .mapInArrow(streams, f"doc_id string, header_site string, {_STREAM}")
        .groupBy("doc_id").agg(F.first(F.struct("header_site", "n", "low", "flag")).alias("p"))
    )
    site = F.coalesce("site", "p.header_site", F.lit(""))
    return streams_df.join(sites, "doc_id", "left").select(
        "doc_id", site.alias("site"), F.xxhash64(site, "p.n", "p.low", "p.flag").alias("body"), "p.n", "p.low", "p.flag"
    )


def _bodies(streams: DataFrame) -> DataFrame:
    """The different streams of a site, with ``title``: of a group of copies the first ``doc_id`` stays. Which ones are
    copies is found without their lines."""
    copies = streams.groupBy("site", "body").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("same")).filter("same > 1")
    keepers = small_side(cut(copies.select("site", "body", "keeper"), "copies"))
    first = F.try_element_at("n", F.lit(1)) == 0
    return streams.join(keepers, ["site", "body"], "left").filter("keeper is null or keeper = doc_id").drop("keeper", "doc_id").withColumn(
        "title", F.when(first, F.try_element_at("low", F.lit(1)))
    )


def _sizes(bodies: DataFrame) -> DataFrame:
    """``site, pages, blocks``: as many blocks per site as it takes to keep one under about BLOCK_PAGES pages."""
    return bodies.groupBy("site").agg(F.count("*").alias("pages")).withColumn(
        "blocks", F.ceil(F.col("pages") / F.lit(BLOCK_PAGES)).cast("int")
    )


def _in_blocks(bodies: DataFrame, sizes: DataFrame) -> DataFrame:
    """The bodies with ``blocks`` and ``block``: pages of one title together, unless they are so many that they are spread."""
    often = bodies.groupBy("site", "title").agg(F.count("*").alias("same")).filter(F.col("same") > BLOCK_PAGES // 4)
    spread_ = F.when(F.col("title").isNull() | F.col("same").isNotNull(), F.col("body"))
    return bodies.join(sizes, "site").join(often, ["site", "title"], "left").withColumn(
        "block", F.pmod(F.xxhash64("title", spread_), "blocks").cast("int")
    ).drop("same", "pages")


def _to_blocks(values: DataFrame, name: str) -> DataFrame:
    """A site's values at each of its blocks."""
    return values.groupBy("site", "blocks").agg(F.collect_list(name).alias(name)).select(
        "site", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), name
    )


def _site_words(streams: DataFrame, sizes: DataFrame) -> DataFrame:
    """``site, block, word`` (an array) of every block of a site that has several: the site's words that aren't slots.
    They are at most RARE_PAGES times the words of a mean page, however large the site is."""

    def rows(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())],
            names=["site", "word", "n"],
        )

    def count(batches):
        seen = Counter()
        for batch in batches:
            for site, stream in zip(batch.column(0).to_pylist(), _of(batch)):
                seen.update([(site, w) for w in _words(stream)])
                if len(seen) >= COUNTED_WORDS:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    several = sizes.filter("blocks > 1")
    counts = streams.join(several.select("site"), "site", "left_semi").select("site", "n", "low", "flag").mapInArrow(count, "site string, word string, n long")
    return _to_blocks(
        counts.groupBy("site", "word").agg(F.sum("n").alias("n")).join(several, "site")
        .filter(F.col("n") > F.greatest(F.lit(1), F.floor(F.col("pages") / F.lit(RARE_PAGES)))),
        "word",
    )


def _title_forms(blocks: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """``site, block, form`` (an array) of every block of a site that has several: the forms of the site's titles, at most
    RARE_TITLES of them. Only titles travel."""
    titles = blocks.filter("blocks > 1 and title is not null").select(
        "site", "block", F.array(F.lit(0)).alias("n"), F.array("title").alias("low"), F.array(F.lit(4).cast("tinyint")).alias("flag")
    )

    def forms(key, table, fixed):
        found = title_forms(_of(table), {w for ws in fixed.column("word").to_pylist() for w in ws})
        return pa.table(
            {"site": pa.array([key[0].as_py()] * len(found), pa.string()), "form": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())}
        )

    counts = titles.groupBy("site", "block").cogroup(words.groupBy("site", "block")).applyInArrow(forms, "site string, form string, n long")
    return _to_blocks(
        counts.groupBy("site", "form").agg(F.sum("n").alias("n")).join(sizes, "site")
        .filter(F.col("n") > F.greatest(F.lit(1), F.floor(F.col("pages") / F.lit(RARE_TITLES)))),
        "form",
    )


def _by_block(streams: DataFrame, function, schema: str) -> DataFrame:
    """``function(site, bodies, shaped, owner, several)`` of every block, its streams shaped by the slots of the whole site;
    ``several``: has the site other blocks?"""
    bodies = _bodies(streams)
    sizes = cut(_sizes(bodies), "sizes")
    blocks = _in_blocks(bodies, sizes)
    words = cut(_site_words(bodies, sizes), "words")
    none = F.array().cast("array<string>")
    of_site = words.select("site", "block", "word", none.alias("form")).unionByName(
        _title_forms(blocks, words, sizes).select("site", "block", none.alias("word"), "form")
    )
    empty = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    nothing = pa.schema([(c.split()[0], empty[c.split()[1]]) for c in schema.split(", ")])

    def run(key, table, known):
        if not table.num_rows:
            return nothing.empty_table()
        table = table.take(pc.sort_indices(table, sort_keys=[("body", "ascending")]))
        several = table.column("blocks")[0].as_py() > 1
        pages = _of(table)
        if several:
            fixed = {w for ws in known.column("word").to_pylist() for w in ws}
            titles = [t for ts in known.column("form").to_pylist() for t in ts]
        else:
            fixed = fixed_words(pages)
            titles = common_titles(pages, fixed)
        return function(key[0].as_py(), table.column("body").to_pylist(), shape(pages, fixed, titles), owners(pages), several).cast(nothing)

    return blocks.groupBy("site", "block").cogroup(of_site.groupBy("site", "block")).applyInArrow(run, schema)


def _of(table) -> list[list[tuple[int, str | None, int, bool]]]:
    """The streams of a table or batch."""
    columns = (table.column(c).to_pylist() for c in ("n", "low", "flag"))
    return [[(n, low, f & 3, f > 3) for n, low, f in zip(*page)] for page in zip(*columns)]


def _decided(elements: DataFrame) -> DataFrame:
    """``eid, chrome`` of the elements (site, eid, support, total, n, solid, slots) the wrappers decide on, summed over
    each site's blocks; :func:`verdict` as an expression."""
    summed = elements.groupBy("eid").agg(
        F.sum("support").alias("support"), (F.sum("total") / F.sum("n")).alias("score"), F.max("solid").alias("solid"), F.max("slots").alias("slots")
    )
    bar = F.lit(CHROME_SCORE) + F.when(F.col("slots"), F.lit(SLOT_MARGIN) / F.sqrt("support")).otherwise(0.0)
    chrome = F.col("solid") & (F.col("support") >= MIN_SUPPORT) & (F.col("score") >= bar)
    own = (F.col("support") >= OWN_SUPPORT) & (F.col("score") < OWN_SCORE)
    return summed.filter(chrome | own).select("eid", chrome.alias("chrome"))


def decided_lines(pages: DataFrame, manifest: DataFrame, text_col: str = "markdown") -> DataFrame:
    """``doc_id, line_no, decided_by`` of the lines that aren't the page's own text, each once: ``wrapper`` where support
    and score of the line's element settle it, ``exemplar`` where they don't and an exemplar or a shape knows the line.

    Repeated rows of a ``doc_id`` count once; null ids, null and empty texts give none, nor does an empty table; pages
    without any address form one site. Only ``doc_id``, the text and the manifest's ``doc_id`` and ``url`` are read.
    """
    streams = cut(site_streams(pages, manifest, text_col), "streams")
    schema = "body long, line_no long, eid long, known boolean, wrapper boolean, support long, total double, n long, solid boolean, slots boolean"

    def find(site, bodies, shaped, owner, several):
        # settled lines; of a site with other blocks the lines that hang on the site's totals, and what to add up
        wrapper = infer_wrapper(shaped, owner)
        sums = element_scores(shaped, wrapper)
        ids = {k: hash_text(f"{site}\n{k}") for k in sums} if several else {}
        solid_ = {k: solid(k) for k in sums}
        here = {} if several else {k: verdict(k, wrapper.support[k], a / n) for k, (a, n) in sums.items()}
        elements = list(sums) if several else []
        body, line, eid, known, by = [], [], [], [], []
        for key, stream in zip(bodies, shaped):
            for n, k, label in stream:
                if several and k is not None and k != "*" and (label > 0 or solid_[k]):
                    row = (ids[k], label > 0, None)
                elif (chrome := here.get(k)) or label > 0 and chrome is None:
                    row = (None, None, bool(chrome))
                else:
                    continue
                body.append(key)
                line.append(n)
                for column, value in zip((eid, known, by), row):
                    column.append(value)
        nothing = [None] * len(body)
        none = [None] * len(elements)
        columns = (
            body + none, line + none, eid + [ids[k] for k in elements], known + none, by + none, nothing + [wrapper.support[k] for k in elements],
            nothing + [sums[k][0] for k in elements], nothing + [sums[k][1] for k in elements], nothing + [solid_[k] for k in elements],
            nothing + ["*" in k for k in elements],
        )
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split(" ")[0] for c in schema.split(", ")])

    found = cut(_by_block(streams, find, schema), "found")
    lines = found.filter("body is not null")
    decided = small_side(cut(_decided(found.filter("body is null")), "decided"))
    open_ = lines.filter("eid is not null").join(decided, "eid", "left").filter(F.coalesce("chrome", "known"))
    settled = lines.filter("eid is null").select("body", "line_no", "wrapper")
    both = settled.unionByName(open_.select("body", "line_no", F.coalesce("chrome", F.lit(False)).alias("wrapper")))
    return both.join(streams.select("doc_id", "body"), "body").select("doc_id", "line_no", F.when(F.col("wrapper"), "wrapper").otherwise("exemplar").alias("decided_by"))


def boilerplate_lines(pages: DataFrame, manifest: DataFrame, text_col: str = "markdown") -> DataFrame:
    """``doc_id, line_no`` of :func:`decided_lines`."""
    return decided_lines(pages, manifest, text_col).select("doc_id", "line_no")


def wrappers(pages: DataFrame, manifest: DataFrame, text_col: str = "markdown") -> DataFrame:
    """``site, element, place, support, optional, repeated, slots, label, score, chrome``: the merged wrapper of each site.
    Support and score add up over its blocks; ``place`` is the mean place in the blocks' wrappers, as a share of their
    length; what one page of the site has is none of it. ``chrome`` is null where the wrapper doesn't decide."""
    streams = cut(site_streams(pages, manifest, text_col), "streams")
    schema = "site string, element string, place double, support long, repeated boolean, slots int, label int, total double, n long, solid boolean"

    def infer(site, bodies, shaped, owner, several):
        wrapper = infer_wrapper(shaped, owner)
        sums = element_scores(shaped, wrapper)
        label: dict[str, int] = {}
        for s in shaped:
            for _, k, known in s:
                label[k] = max(label.get(k, 0), known)
        keys = [k for k in sums if several or wrapper.support[k] > 1]
        size = max(1, len(wrapper.order) - 1)
        columns = (
            [site] * len(keys), keys, [wrapper.place[k] / size if k in wrapper.place else None for k in keys],
            [wrapper.support[k] for k in keys], [k in wrapper.repeated for k in keys], [k.split(" ").count("*") + k.count("¤") for k in keys],
            [label[k] for k in keys], [sums[k][0] for k in keys], [sums[k][1] for k in keys], [solid(k) for k in keys],
        )
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.bool_())
        names = [c.split(" ")[0] for c in schema.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    elements = cut(_by_block(streams, infer, schema), "elements").withColumn("eid", F.xxhash64("site", "element"))
    decided = _decided(elements.withColumn("slots", F.contains("element", F.lit("*"))))
    merged = (
        elements.groupBy("site", "element", "eid")
        .agg(F.avg("place").alias("place"), F.sum("support").alias("support"), F.bool_or("repeated").alias("repeated"), F.max("slots").alias("slots"),
             F.max("label").alias("label"), (F.sum("total") / F.sum("n")).alias("score"))
        .filter("support > 1")
    )
    return merged.join(decided, "eid", "left").join(_sizes(_bodies(streams)), "site").select(
        "site", "element", F.round("place", 4).alias("place"), "support", (F.col("support") < F.col("pages")).alias("optional"), "repeated",
        "slots", "label", F.round("score", 4).alias("score"), "chrome",
    )
