"""Text rules: patterns, word lists and expressions over a dialect.

Each function returns the text of an expression on the given column names.
"""

from __future__ import annotations

from .dialect import Spark

# Patterns and word lists of the boundary rules, as the rules define them.
TAG = r"</?[^>]+>|\{\\[^}]+\}"
STRONG_END = r"""[.!?…؟？！]+["'’”»)\]}]*$"""
QUESTION_END = r"""[?؟？][ "'’”»)\]}]*$"""
DASH = r"^\s*(?:--?|[–—]|>>)\s+"
VOICE = r"^\s*(?:<v(?:\s+[^>]*)?>|\[[\p{L}\p{Nl}\p{No}]{1,31}\]\s*|[A-ZÀ-ɏ][A-Za-z0-9 ._-]{0,30}:)"
VOICE_NAME = r"^\s*<v\s+(\S[^>]*)>"
BRACKET_NAME = r"^\s*\[([\p{L}\p{Nl}\p{No}]{1,31})\]\s*"
LABEL_NAME = r"^\s*([A-ZÀ-ɏ][A-ZÀ-ɏ0-9 ._-]{1,30}):(?:\s|$)"
TOKEN = r"[\p{L}\p{Nl}\p{No}]+(?:['’\-][\p{L}\p{Nl}\p{No}]+)*"
ENGLISH_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
CONTRACTION = r"(?i)^(['´‘’](?:m|t|ve|re|ll|s|d|em))(?:[^\p{L}\p{N}_]|$)"
CONTRACTION_SUFFIX = r"(?i)^['´‘’](m|t|ve|re|ll|s|d|em)(?:[^\p{L}\p{N}_]|$)"
LAST_WORD = r"([A-Za-z]+)$"
CLOSING_TAG = r"^</[^>]+>"
NO_SPACE_BEFORE = r"^[,.!?;:%)\]}»”]"
NO_SPACE_AFTER = r"[(\[{«“]$"
EDGE, TAIL = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
FINITE_VERB = (
    rf"(?i){EDGE}(?:am|are|can|could|did|do|does|had|has|have|is|may|might|must|shall|should|was|were|will|would|"
    r"won't|can't|don't|doesn't|didn't|i'm|you're|he's|she's|it's|we're|they're|i'll|you'll|we'll|they'll|"
    rf"think|thinks|thought|suspect|suspects|tell|tells|told|want|wants|need|needs|know|knows|knew|escaped|issue|live|die){TAIL}"
)
COMPLEMENT = rf"(?i){EDGE}(?:i['’]?ll|i\s+will|i\s+can)\s+(?:tell|show|explain)\s+(?:you|him|her|them){TAIL}"
COMPARATIVE = rf"(?i)^\s*better\s+to{TAIL}"
SUBORDINATE_STARTS = ("although", "because", "if", "since", "though", "unless", "when", "while")
CONTINUATION_STARTS = ("and", "as", "because", "but", "for", "if", "nor", "or", "so", "that", "while")
CONTINUATION_PRONOUNS = ("her", "his", "its", "my", "our", "their", "the", "this", "that", "your")
WH_STARTS = ("how", "what", "when", "where", "which", "who", "whom", "whose", "why")
QUESTION_STARTS = (
    "am", "are", "can", "could", "did", "do", "does", "had", "has", "have", "how", "is", "may", "must",
    "should", "was", "were", "what", "when", "where", "which", "who", "whom", "whose", "why", "will", "would",
)
INCOMPLETE_ENDINGS = ("a", "an", "and", "as", "at", "because", "but", "for", "if", "of", "or", "than", "to", "with")
NEGATED_STEMS = (
    "aren", "can", "couldn", "daren", "didn", "doesn", "don", "hadn", "hasn", "haven", "isn", "mightn",
    "mustn", "needn", "shan", "shouldn", "wasn", "weren", "won", "wouldn",
)
OBJECT_WORDS = ("her", "him", "them", "us", "me", "my", "your", "our", "their", "his", "its")
NO_RE_WORDS = ("her", "him", "us", "me", "my", "your", "our", "their", "his", "its", "he", "she", "it")
CAPTION_MUSIC = r"[♫♪🎵🎶]"
CAPTION_BRACKET = r"^[\(\[【][^\)\]】]{1,60}[\)\]】]\s*$"
CAPTION_SOUND = (
    r"(?i)^[\(\[【]\s*(?:risas|música|aplausos|gritos|llora|suspiros|teléfono|timbre|disparo|explosión|ruido|sonido|canción|voz|narrador|"
    r"subtítulos|lágrimas|tose|susurra|gime|respira|murmura|tartamudea|sollozando|tosiendo|bostezo|estornudo|pita|pitido|alarma|sirena|trueno|"
    r"lluvia|olas|viento)\s*[\)\]】]?\s*$"
)
ELLIPSIS = r"\.\.\.|…"
SHORT_WORDS = ("sí", "no", "sip", "nop", "vale", "ok", "okay")
SHORT_PHRASES = (
    "sí", "no", "claro", "vale", "bueno", "ok", "okay", "sip", "nop", "ya", "dale", "listo", "hecho", "por supuesto",
    "desde luego", "está bien", "de acuerdo", "tal vez", "quizás", "quizá",
)
ABBREVIATIONS = ("Dr.", "Dra.", "Sr.", "Sra.", "Sta.", "etc.", "ej.", "pág.", "Vol.", "vs.")
AFTER_PERIOD = ("y", "e", "ni", "o", "u", "que", "pero", "mas", "porque")
CONJUNCTIONS = ("y", "e", "ni", "que", "pero", "mas", "sino", "aunque", "porque", "pues", "como", "mientras", "si", "o", "u")


def among(x: str, values: tuple[str, ...]) -> str:
    return f"coalesce({x} IN ({', '.join(repr(v) for v in values)}), false)"


def visible(d: Spark, x: str) -> str:
    return f"trim({d.replace(x, TAG, '')})"


def normalised(d: Spark, x: str) -> str:
    return f"trim({d.replace(visible(d, x), r'[ \t\n\r\f]+', ' ')})"


class English:
    """English signals on a visible text column x and its words column w (`xv`, `xw` for side x)."""

    def __init__(self, d: Spark):
        self.d = d

    def first(self, s: str) -> str:
        return f"lower({self.d.item(f'{s}w', '1')})"

    def strong(self, s: str) -> str:
        return self.d.match(f"{s}v", STRONG_END)

    def new_sentence(self, s: str) -> str:
        return f"({self.d.match(f'{s}v', VOICE)} OR {self.d.match(f'{s}v', '^[^A-Za-z]*[A-Z]')})"

    def question(self, s: str) -> str:
        n = self.d.size(f"{s}w")
        return f"({self.d.match(f'{s}v', QUESTION_END)} OR {among(self.first(s), QUESTION_STARTS)} OR ({among(self.first(s), ('any',))} AND {n} > 1))"

    def complete(self, s: str) -> str:
        return f"({self.strong(s)} OR {self.question(s)} OR ({self.d.size(f'{s}w')} >= 2 AND {self.d.match(f'{s}v', FINITE_VERB)}))"

    def incomplete(self, s: str) -> str:
        n, last = self.d.size(f"{s}w"), f"lower({self.d.item(f'{s}w', '-1')})"
        return (
            f"({n} > 0 AND NOT {self.strong(s)} AND NOT {self.question(s)} AND ({n} = 1 OR {among(last, INCOMPLETE_ENDINGS)}"
            f" OR {among(self.first(s), SUBORDINATE_STARTS)} OR {self.d.match(f'{s}v', '[a-z]$')}))"
        )

    def score(self) -> str:
        d, fl, fr = self.d, self.first("l"), self.first("r")
        nl, nr = d.size("lw"), d.size("rw")
        return (
            f"CAST(CASE WHEN {nl} = 0 OR {nr} = 0 THEN 0 ELSE"
            f" CASE WHEN {d.match('rv', '^[^A-Za-z]*[a-z]')} AND {nr} >= 2 THEN 2 ELSE 0 END"
            f" + CASE WHEN {among(fr, ('than',))} AND {nr} >= 3 AND {d.match('lv', COMPARATIVE)} THEN 3 ELSE 0 END"
            f" + CASE WHEN {among(fl, SUBORDINATE_STARTS)} AND {among(fr, CONTINUATION_PRONOUNS)} AND {nl} >= 3 AND {nr} >= 3 AND {self.complete('r')} THEN 3 ELSE 0 END"
            f" + CASE WHEN {among(fr, WH_STARTS)} AND {nr} >= 3 AND {self.new_sentence('r')} AND {d.match('lv', COMPLEMENT)} THEN 4 ELSE 0 END"
            f" + CASE WHEN {among(fr, CONTINUATION_STARTS)} AND NOT {self.strong('l')} AND {nr} >= 2 THEN 2 ELSE 0 END END AS BIGINT)"
        )

    def independent(self, score: str) -> str:
        lower_wh = f"({among(self.first('r'), WH_STARTS)} AND {self.strong('r')})"
        starts = f"({self.new_sentence('r')} OR {lower_wh})"
        return (
            f"({score} = 0 AND {self.complete('l')} AND {self.complete('r')}"
            f" AND NOT ({self.incomplete('l')} AND NOT ({self.strong('r')} AND {starts}))"
            f" AND NOT ({self.incomplete('r')} AND NOT {self.strong('r')}) AND {starts})"
        )

    def join_issue(self, left: str, right: str) -> str:
        """Why joining would spoil a contraction, or null."""
        d = self.d
        mark = d.extract(f"ltrim({right})", CONTRACTION)
        suffix = f"lower({d.extract(f'ltrim({right})', CONTRACTION_SUFFIX)})"
        word = d.extract(f"rtrim({left})", LAST_WORD)
        base = f"lower({word})"
        unsafe = f"concat({mark}, ' cannot safely attach to ', {word})"
        return (
            f"CASE WHEN trim({left}) = '' OR trim({right}) = '' THEN 'subtitle fragments must contain non-whitespace text'"
            f" WHEN {mark} = '' THEN NULL WHEN {word} = '' THEN 'apostrophe-leading contraction has no preceding word'"
            f" WHEN {suffix} = 'm' AND {base} <> 'i' THEN concat({mark}, ' can only attach safely to I')"
            f" WHEN {suffix} = 't' AND NOT {among(base, NEGATED_STEMS)} THEN {unsafe}"
            f" WHEN {among(suffix, ('ve', 'll', 'd'))} AND {among(base, OBJECT_WORDS)} THEN {unsafe}"
            f" WHEN {suffix} = 're' AND {among(base, NO_RE_WORDS)} THEN {unsafe} END"
        )


def attaches(d: Spark, left: str, right: str, english: str) -> str:
    """Whether right follows left without a space; `english` says if contractions count."""
    safe = f"({english} AND {d.match(right, CONTRACTION)} AND ({English(d).join_issue(left, right)}) IS NULL)"
    return f"({d.match(right, NO_SPACE_BEFORE)} OR {d.match(right, CLOSING_TAG)} OR {d.match(left, NO_SPACE_AFTER)} OR {safe})"


def speaker_of(d: Spark, line: str) -> str:
    """The name that a line gives, or null."""
    names = [f"nullif(trim({d.extract(line, p)}), '')" for p in (VOICE_NAME, BRACKET_NAME, LABEL_NAME)]
    return f"coalesce({', '.join(names)})"


def short_response(d: Spark, x: str) -> str:
    words = f"{d.filter(d.split(x, ' +'), 'q', chr(113) + chr(32) + '<>' + chr(32) + chr(39) * 2)}"
    bare = d.replace(f"lower({d.item(words, '1')})", r"""^[¿¡.!?…,;:"']+|[¿¡.!?…,;:"']+$""", "")
    whole = d.replace(f"lower({x})", r"^[¿¡.!?…]+|[¿¡.!?…]+$", "")
    return f"({d.size(words)} BETWEEN 1 AND 3 AND {among(bare, SHORT_WORDS)} AND ({among(whole, SHORT_PHRASES)} OR {d.size(words)} <= 2))"


def misleading_period(d: Spark, left: str, right: str) -> str:
    last = d.item(d.split(f"rtrim({left})", " +"), "-1")
    first = f"lower({d.item(d.split(right, ' +'), '1')})"
    return (
        f"({d.match(f'rtrim({left})', r'\.$')} AND NOT {d.match(left, ELLIPSIS)} AND (coalesce({d.match(last, r'^[A-Za-z]\.$')}, false) OR {among(last, ABBREVIATIONS)}"
        f" OR {d.match(right, r'^\p{Ll}')} OR {among(first, AFTER_PERIOD)}))"
    )


def caption(d: Spark, x: str, v: str) -> str:
    return f"({v} <> '' AND ({d.match(v, CAPTION_MUSIC)} OR {d.match(f'trim({x})', CAPTION_BRACKET)} OR {d.match(f'trim({x})', CAPTION_SOUND)}))"
