"""Template residue, filler, error-page text and script notices in place of content."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from depguard.plans.skew import hot_keys, spread_join

# ---- fixed values: how slots, filler, errors and notices are written -------------------------------------------------

_NAME = r"[^\W\d_][\w.]*(?:[ -][^\W\d_][\w.]*){0,3}"
_CAPS = r"(?:(?![a-zß-ÿ])[^\W\d]){3,}(?: (?:(?![a-zß-ÿ])[^\W\d])+){0,3}"
_TAGS = "html|head|body|meta|link|script|noscript|style|div|span|p|br|hr|a|b|i|u|em|strong|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|h1|h2|h3|h4|h5|h6|pre|code|img|form|input|button|label|nav|main|aside|center|font|sub|sup|small|big|tt|blockquote|iframe|svg|math"
#: An unfilled slot, as a whole unit.
SLOTS = (
    rf"\{{\{{\s*{_NAME}\s*\}}\}}",
    rf"\{{%\s*block\s+{_NAME}\s*%\}}.*",
    rf"[$#]\{{\s*{_NAME}\s*\}}",
    rf"<<\s*{_NAME}\s*>>",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"<%=?\s*{_NAME}\s*%>",
    rf"(%%|@@|##|__|~~)\s?{_NAME}\1",
    rf"XX-{_NAME}-XX",
    rf"\${_CAPS}\$",
    rf"&lt;\s*{_NAME}\s*&gt;",
    rf"<(?!(?i:{_TAGS})>){_CAPS}>",
    rf"\[{_CAPS}\]",
    rf"\[{_NAME} ?(?:---?|–|—|:) ?(?i:to be (?:completed|added|supplied|inserted|announced)|à compléter|zu ergänzen|por completar)\]",
    rf"[<\[](?i:please (?:fill in|complete|insert|add)|fill in|bitte (?:ergänzen|ausfüllen|eintragen)|à compléter|à remplir|completar|rellenar|por favor complete) ?: ?{_NAME}[>\]]",
    rf"[<\[](?i:add|insert|enter|your|put|fill in|ajouter|insérer|añadir|insertar) {_NAME}[>\]]",
    rf"[<\[](?i:{_NAME} (?:hinzufügen|einfügen|eintragen|ergänzen))[>\]]",
    rf"\((?i:{_NAME} to be (?:supplied|provided|added|completed|inserted) by the (?:author|editor)s?)\)",
    rf"\[(?i:(?:insert|add|enter|put|type|your) [^\[\]]{{2,}} here|insertar [^\[\]]{{2,}} aquí|insérer [^\[\]]{{2,}} ici|[^\[\]]{{2,}} hier (?:einfügen|eintragen|ergänzen))\]",
    rf"(?i:your {_NAME} (?:goes|comes|belongs) here)\.?",
    rf"(?i:(?:type|enter|write|put|insert|add) (?:your |the )?{_NAME} here)\.?",
    rf"(?i:hier (?:bitte )?{_NAME} (?:eintragen|einfügen|ergänzen|eingeben))\.?",
    rf"(?i:(?:escriba|escribe|introduzca|inserte|ponga) (?:aquí|su)) ?:? ?{_NAME}\.?",
    rf"(?i:(?:saisissez|écrivez|insérez|entrez|indiquez) ici) ?:? ?{_NAME}\.?",
    rf"(?i:click here to enter {_NAME})\.?",
    rf"%\({_NAME}\)[sd]",
    rf"(?i:replace this (?:text|line|sentence) (?:with|by) (?:the |your )?{_NAME}(?: of your (?:article|paper))?)\.?",
    rf"(?i:(?:diesen|den) text durch {_NAME} ersetzen)\.?",
    rf"(?i:remplace[rz] ce texte par) ?:? ?{_NAME}\.?",
    rf"(?i:(?:sustituya|reemplace|sustituir|reemplazar) este texto (?:por|con)) ?:? ?{_NAME}\.?",
)
#: Words of pseudo-Latin filler.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt labore
    dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute
    irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
    culpa qui officia deserunt mollit anim est laborum pulvinar rutrum justo nunc massa ligula donec ornare felis augue varius
    mollis tempus cursus porta vitae et lectus ut in ad eu id ac at vel nec porttitor vestibulum pellentesque suspendisse
    curabitur praesent aenean maecenas phasellus nullam morbi mauris fusce vivamus integer etiam proin nam turpis egestas
    tincidunt faucibus fermentum ultrices posuere cubilia curae libero eget orci tristique senectus netus malesuada fames
    feugiat pretium viverra accumsan bibendum blandit condimentum convallis dapibus diam dictum dignissim efficitur elementum
    erat eros euismod facilisis finibus gravida habitant hendrerit iaculis imperdiet interdum lacinia lacus laoreet leo
    lobortis luctus mattis metus molestie neque odio pharetra placerat purus quam rhoncus risus sagittis sapien scelerisque
    semper sodales sollicitudin tellus tortor ultricies urna vehicula venenatis volutpat vulputate""".split()
)
#: Names that stand for any name.
META = frozenset("foo bar baz qux quux quuz corge grault garply waldo fred plugh xyzzy thud foobar spam eggs toto tata titi tutu blah bla blub".split())
#: Sentences that say they are no content.
FILLER = (
    r"demo (?:content|text|copy)\b", r"remove before (?:submission|publication|printing)", r"texte provisoire\b", r"paragraphe d'exemple", r"(?:texte|paragraphe|phrase) (?:d'essai|de démonstration|fictive?)",
    r"(?:beispiel|muster|platzhalter|blind|füll)(?:text|absatz|satz)\b", r"(?:párrafo|texto|frase) (?:de (?:ejemplo|relleno|muestra|prueba)|provisional|ficticio)",
    r"this is (?:just |only )?(?:a )?(?:dummy|placeholder|sample|filler|blind|example) (?:text|copy|paragraph|prose)",
    r"(?:this|the) (?:section|paragraph|page|text|abstract|chapter|passage) (?:intentionally )?(?:holds|contains|is) (?:only |just )?(?:a )?(?:placeholder|filler|dummy)",
    r"(?:the )?quick sample sentence fills", r"sample (?:paragraph|text|copy|sentence)s? (?:for layout|to show|goes here|only)",
    r"here (?:comes|goes|stands) some text that stands in for", r"text that stands in for the real one", r"it only shows how a printed page would look",
    r"dies ist (?:nur )?(?:ein )?(?:nur )?(?:blindtext|mustertext|platzhalter|fülltext|beispieltext)", r"(?:hier steht|es folgt) (?:nur )?(?:ein )?(?:blindtext|mustertext|platzhalter)",
    r"(?:ceci est|voici) (?:un |du )?(?:faux[- ]texte|texte (?:factice|de remplissage|d'exemple|provisoire))",
    r"(?:este es|esto es) (?:un )?texto (?:de relleno|de ejemplo|ficticio|de prueba|simulado|provisional)",
)
_SIGNS = r"(?:x{6,}|X{6,}|\.{6,}|_{6,}|(?:\. ){5,}\.?|(?:X{3,}\s+){2,}X{3,}|(?:x{3,}\s+){2,}x{3,}|a{3,} b{3,} c{3,}(?: [a-z]{3,})*|(?i:asdf[\w ]*|qwerty[\w ]*))"
#: Errors shown instead of content, at the start of a unit in lower case without markup.
ERRORS = (
    r"http/\d(?:\.\d)? [45]\d\d\b", r"(?:http )?(?:error|fehler|erreur|error|status)(?: code)? ?[45]\d\d ?(?:[:.\-–—(]|$)",
    r"[45]\d\d (?:[-–—:] )?(?:bad request|unauthorized|payment required|forbidden|not found|page not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)",
    r"(?:page|file|document|article) not found\.?$", r"access (?:denied|forbidden)\b", r"access to (?:this|the) (?:\w+ ){1,3}(?:was|is|has been) (?:denied|blocked|restricted|refused)",
    r"(?:your|the) session (?:has |was )?(?:expired|timed out|ended)", r"ihre sitzung (?:ist|wurde)", r"votre session (?:a|est) ", r"su sesión (?:ha|está)",
    r"(?:the )?source of this (?:submission|article|paper|document) (?:has been|was|is) (?:withdrawn|moved|removed|not available|unavailable)",
    r"(?:upstream|request|connection|gateway|server) (?:has )?timed? ?out\b", r"(?:unhandled|uncaught|fatal) (?:exception|error)\b", r"traceback \(most recent call last\)",
    r"(?:we are|we're|i'm) sorry,? (?:but )?(?:this|the|that|your|we)\b", r"sorry,? (?:this|the) (?:page|paper|article|file) ",
    r"(?:unknown|invalid|no such|missing) (?:article|document|paper|record|page)(?: identifier| id| number)?\b.{0,40}$",
    r"oops\b", r"something went wrong\b", r"an? (?:unexpected|internal|unknown) (?:server )?error (?:has )?occurred",
    r"the (?:page|file|document|article|url|paper) you (?:asked for|requested|are looking for|were looking for)", r"the requested (?:url|page|resource|document|file) ",
    r"this (?:repository|site|archive|server|service|page|system) is (?:currently |temporarily )?(?:down|unavailable|offline|under maintenance|not available|closed)",
    r"(?:database|server) (?:connection )?(?:failed|error|failure|is (?:down|busy|overloaded))", r"could not connect to (?:the )?(?:database|server)", r"too many (?:requests|downloads|connections|attempts)\b",
    r"zugriff (?:verweigert|gesperrt|nicht)", r"(?:diese |die )?(?:seite|datei) (?:wurde )?nicht gefunden", r"der (?:dienst|server|artikel) ist (?:derzeit|momentan|zurzeit|zur zeit|leider)? ?nicht (?:erreichbar|verfügbar)", r"die (?:seite|verbindung) (?:ist|wurde|konnte) ",
    r"interner (?:server)?fehler", r"es ist ein (?:interner )?fehler aufgetreten", r"acc[eè]s (?:refusé|interdit|non autorisé)", r"(?:cette )?page (?:introuvable|non trouvée|indisponible)", r"(?:le|ce) (?:service|serveur|site) est (?:momentanément|temporairement|actuellement)? ?(?:indisponible|inaccessible)",
    r"erreur (?:interne|du serveur|de connexion)", r"une erreur (?:interne |inattendue )?(?:est survenue|s'est produite)", r"acceso (?:denegado|prohibido|no autorizado)", r"(?:la )?página (?:no encontrada|no disponible)", r"el (?:servicio|servidor|sitio) (?:no está|está|se encuentra) ",
    r"error (?:interno|del servidor|de conexión)", r"(?:se ha producido|ha ocurrido) un error",
)
_SCRIPT = r"(?:java ?scripts?|js|scripts?|scripting|active scripting)"
#: Notices that scripts are required, likewise.
NOTICES = (
    rf"(?:please )?(?:enable|activate|allow|turn on|switch on) {_SCRIPT}\b", rf"you (?:need|have|must|will need)(?: to)? (?:allow|enable|activate|turn on|have) {_SCRIPT}\b", rf"this (?:page|site|viewer|reader|article|application|app|website) (?:requires|needs|uses|works best with|relies on) {_SCRIPT}\b",
    rf"(?:your|the) browser (?:does not|doesn't|must|needs to|should|has) (?:support|run|have|allow|enable)? ?{_SCRIPT}\b", rf"{_SCRIPT} (?:is|are|must be|needs to be|has to be|seems to be|appears to be|should be) (?:disabled|required|needed|turned off|switched off|off|blocked|enabled|activated|turned on|not)\b",
    rf"for full functionality\b.*\b{_SCRIPT}\b", rf"the (?:reader|viewer|page|article|document|site) (?:could|can|can ?not|will) ?(?:not)? (?:start|load|be (?:shown|displayed|loaded)|run|open|work).*\b{_SCRIPT}\b",
    rf"to (?:view|read|use|see|continue|display)\b.*\b(?:enable|activate|allow|turn on)\b.*{_SCRIPT}\b", rf"(?:bitte )?(?:aktivieren|erlauben|schalten) sie\b.*\b{_SCRIPT}\b", rf"für diese (?:ansicht|seite|anzeige|anwendung) (?:wird|ist|müssen|muss)\b.*\b{_SCRIPT}\b", rf"diese (?:seite|ansicht|anwendung) (?:benötigt|erfordert|braucht)\b.*\b{_SCRIPT}\b", rf"{_SCRIPT} (?:ist|wird|muss) .{{0,20}}(?:deaktiviert|benötigt|ausgeschaltet|erforderlich|aktiviert)",
    rf"(?:veuillez |merci d')(?:activer|autoriser)\b.*\b{_SCRIPT}\b", rf"(?:cette|ce) (?:page|site|lecteur|visionneuse) (?:nécessite|requiert|exige|a besoin)\b.*\b{_SCRIPT}\b", rf"{_SCRIPT} (?:est|doit être) .{{0,20}}(?:désactivé|requis|nécessaire|activé)", rf"vous devez (?:activer|autoriser)\b.*\b{_SCRIPT}\b",
    rf"(?:por favor,? )?(?:active|habilite|permita|activa)\b.{{0,12}}\b{_SCRIPT}\b", rf"(?:esta|este) (?:página|sitio|visor|lector) (?:requiere|necesita|exige)\b.*\b{_SCRIPT}\b", rf"{_SCRIPT} (?:está|debe estar) .{{0,20}}(?:desactivado|deshabilitado|activado|habilitado)", rf"se (?:requiere|necesita) {_SCRIPT}\b", rf"(?:es necesario|debe|necesita) (?:activar|habilitar|permitir) {_SCRIPT}\b",
)

# ---- end of fixed values ----------------------------------------------------------------------------------------------

_SLOT = re.compile("(?:" + "|".join(f"(?:{s.replace(chr(92) + '1', '(?P=mark)').replace('(%%|', '(?P<mark>%%|')})" for s in SLOTS) + r")\Z")
_FILL, _SIGN = re.compile("(?:" + "|".join(FILLER) + ")"), re.compile(_SIGNS + r"\Z")
_ERROR, _NOTICE = re.compile("(?:" + "|".join(ERRORS) + ")"), re.compile("(?:" + "|".join(NOTICES) + ")")
_BREAK, _TAG = re.compile(r"\r\n|\n|\r"), re.compile(r"<[^<>]*>")
_WRAP = re.compile(r"\\(?:title|author|thanks|caption|section|subsection|subsubsection|paragraph|textbf|textit|emph|date|affil|affiliation|address|email|keywords|footnote|abstract|chapter|centerline|texttt)\*?\{(.*)\}\Z")
_LABEL = re.compile(r"[^\W\d_]{2,20}:\s+(.*)\Z")
_COMMENT = re.compile(r"(?<!\\)%.*")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS, _HEX = re.compile(r"\d+"), re.compile(r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{6,}\b")


def normalise(line: str) -> str:
    """A line as it is counted: trimmed, lower case, numbers and long hexadecimal ids as 0."""
    return _DIGITS.sub("0", _HEX.sub("0", line.strip().lower()))


def units(line: str) -> Iterator[str]:
    """The line without markup around it, then what a heading command or a label holds."""
    s = line.strip()
    yield s
    while m := _WRAP.match(s):
        s = m[1].strip()
        yield s
    if m := _LABEL.match(s):
        yield m[1].strip()


def evidence(line: str) -> str | None:
    """slot, filler, error or script if the line shows it in place of content.

    A line in a comment (from an unescaped % on) shows nothing, but for a slot written with %. Slots must be the whole
    line or all that a heading, a label or a simple element holds: text that quotes one isn't a slot. Errors, notices and
    filler sentences must begin the line, as articles about them don't.
    """
    s = line.strip()
    if not s:
        return None
    for u in units(s):
        if _SLOT.match(u):
            return "slot"
    if "%" in s:
        s = _COMMENT.sub("", s).strip()
        if not s:
            return None
    plain = _TAG.sub(" ", s).strip() if "<" in s else s
    if plain != s and _SLOT.match(plain):
        return "slot"
    if not plain:
        return None
    for u in units(plain):
        low = u.lower()
        if _SIGN.match(u) or _FILL.match(low):
            return "filler"
        if _ERROR.match(low):
            return "error"
        if _NOTICE.match(low):
            return "script"
        if "\\" not in u:
            words = _LETTERS.findall(low)
            if len(words) >= 4:
                latin = sum(w in LATIN for w in words)
                if latin >= 4 and latin * 4 >= len(words) * 3 or all(w in META for w in words):
                    return "filler"
                if len(words) >= 6 and len(set(words)) == 1:
                    return "filler"
    return None


_SCHEMA = "host string, h bigint, n bigint, key {kind}, kind string, content boolean"
#: A line that at least half of a host's documents have is the host's boilerplate. Hosts with fewer than ten documents, too
#: few to tell, are looked at together: their boilerplate is what half of all their documents have, if these are ten.
SHARE, LEAST = 0.5, 10


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def residue(docs: DataFrame, key: str, text: str, host: str, scratch, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """key, kinds (sorted array), lines (number of lines with evidence), whole: the documents of which at least a part
    is residue; whole is true if nothing else is left of them.

    Every document's normalised lines are counted by host in one pass (each line once a document, counts combined in
    the task before they are shuffled); the same pass emits the lines of documents that show evidence. Lines that recur
    in at least `share` of a host's documents (of all small hosts' documents, if it has fewer than `least`) are its
    boilerplate and are subtracted, so a notice in the frame that a host puts round every page is no evidence, unless
    nothing but boilerplate is left of the document. What remains is judged by line.

    Null texts show nothing; a null host counts as one host. Keys should be unique. Texts are read whole.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: Counter = Counter()
            rows = []
            for k, x, s in zip(b["k"], b["x"], b["s"]):
                if x is None:
                    continue
                seen: dict[str, tuple[str | None, str]] = {}
                for line in dict.fromkeys(_BREAK.split(x)):
                    if line and not line.isspace():
                        n, e = normalise(line), evidence(line)
                        if e or n not in seen:
                            seen[n] = e, line
                counts.update((s, _hash(n)) for n in seen)
                counts[s, None] += 1
                shown = [(n, e, line) for n, (e, line) in seen.items()]
                if any(e for _, e, _ in shown):
                    rows += [(s, _hash(n), None, k, e, e is None and bool(_LETTERS.search(_TAG.sub("", _COMMENT.sub("", line)))) and not line.lstrip().startswith(("\\documentclass", "\\begin{document}", "\\end{document}"))) for n, e, line in shown]
            rows += [(s, h, n, None, None, None) for (s, h), n in counts.items()]
            yield pd.DataFrame(
                {
                    "host": pd.Series([r[0] for r in rows], dtype=object),
                    "h": pd.array([r[1] for r in rows], dtype="Int64"),
                    "n": pd.array([r[2] for r in rows], dtype="Int64"),
                    "key": pd.Series([r[3] for r in rows], dtype=object) if kind == "string" else pd.array([r[3] for r in rows], dtype="Int64"),
                    "kind": pd.Series([r[4] for r in rows], dtype=object),
                    "content": pd.array([r[5] for r in rows], dtype="boolean"),
                }
            )

    d = docs.select(F.col(key).alias("k"), F.col(text).alias("x"), F.col(host).alias("s"))
    found = scratch.write(d.mapInPandas(run, _SCHEMA.format(kind=kind)), "lines")
    counts = found.filter("n is not null").withColumn("host", F.coalesce("host", F.lit("\0"))).groupBy("host", "h").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "counts")
    sizes = counts.filter("h is null").select("host", F.col("n").alias("docs"))
    total, small = sizes.agg(F.sum("docs"), F.sum(F.when(F.col("docs") < least, F.col("docs")))).first()
    by_host = spread_join(counts.filter("h is not null"), sizes, ["host"], hot_keys(sizes, ["host"], "docs", total or 0))
    frame = by_host.filter((F.col("docs") >= least) & (F.col("n") >= F.col("docs") * share))
    if (small or 0) >= least:
        # A line in half of some documents: there are at most two for each line that these have on average.
        pool = by_host.filter(F.col("docs") < least)
        common = pool.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= small * share).select("h")
        frame = frame.unionByName(pool.join(F.broadcast(common), "h", "left_semi"))
    frame = scratch.write(frame.select("host", "h", "n"), "frame")
    shown = found.filter("n is null").withColumn("host", F.coalesce("host", F.lit("\0")))
    j = spread_join(shown, frame.select("host", "h", F.lit(True).alias("common")), ["host", "h"], hot_keys(frame, ["host", "h"], "n", total or 0))
    left = F.col("common").isNull()
    own = j.groupBy("key").agg(
        F.count_if(F.col("kind").isNotNull() & left).alias("own"), F.count_if(F.col("kind").isNotNull()).alias("lines"),
        F.count_if(F.col("content") & left).alias("rest"), F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    return own.filter("own > 0 or rest = 0").select(F.col("key").alias(key), "kinds", "lines", (F.col("rest") == 0).alias("whole"))


def without_residue(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The documents that aren't in `found`, all columns."""
    return docs.join(found.select(key), key, "left_anti").select(*docs.columns)
