"""Problem 5: template residue, filler, error messages and demands for scripts.

Lines are normalised (letters only, lower case) and their records counted per host. Recurrent boilerplate is subtracted:
lines that stand in many records of the host, or of several hosts, most of which have content of their own. (A message
that recurs on pages that hold nothing else is no boilerplate, whatever its number; a notice below every article is.)
Only what is left, the residual, is searched for evidence:

* unfilled placeholders in prose or title (code fences, code spans and data are left out);
* lines that are filler, an error, blocking or maintenance message, or a demand for scripts or a browser check.

A placeholder is enough; messages and filler count when they, and not prose, make up what is left.

Contents are read once, and leave that pass as arrays of hashes; all that follows is counted on these. Counts are
combined before they are shuffled, by host and line, so that no large host meets in one task.

Defined cases: null and blank contents are no cases; status codes are not looked at; several rows of one id count
as one record, the latest delivery (by ``ingested_at``, then the content's hash) standing for it; a record without a
host has no boilerplate of its host; an empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, scrapes, site
from .lines import MIN_RECORDS, ONE_IN, line_hashes

# Forms of unfilled placeholders (patterns of common template languages).
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[\w.|\-\s]{1,60}\}?\}\}"  # {{ name }}
    r"|\{%-?\s*[\w.\s]{1,60}-?%\}"  # {% name %}
    r"|<%[=\-]?\s*[\w.\s\[\]'\"]{1,60}%>"  # <%= name %>
    r"|[$#]\{\s*[\w.]{1,60}\s*\}"  # ${name} #{name}
    r"|\[\[\s*[\w.\-]{1,60}\s*\]\]"  # [[name]]
    r"|<<\s*[A-Za-z][\w.]{0,60}\s*>>"  # <<name>>
    r"|%%[A-Za-z]\w{0,60}%%|@@[A-Za-z]\w{0,60}@@|##[A-Za-z]\w{0,60}##"
    r"|(?<!\w)%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?!\w)"  # %NAME%
    r"|(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)"  # __NAME__
    r"|(?<!\w)XX_[A-Z][A-Z0-9_]*_XX(?!\w)|(?<!\w)\[(?:INSERT|YOUR|ENTER|ADD|INSIRA|INSERTAR|INSERER)\b[^\]\n]{0,50}\](?!\()"
    r"|\[(?:[Yy]our|[Ii]nsert|[Ee]nter) [\w ]{2,40}\](?!\()"  # [Your company name]
    r"|(?<![\w{$#%])\{[a-z][a-z0-9]*(?:[_.][a-z0-9]+)*\}(?!\})"  # {name}
    r"|\[object Object\]|(?<!\w)undefined undefined(?!\w)|(?<!\w)null null(?!\w)"
)
# How placeholders begin, each with the characters to look for first.
_BEGINNINGS = [
    ("{", re.compile(r"\{[{%a-z]|[$#]\{")),
    ("[", re.compile(r"\[(?:\[|[A-Z]{3}|[Yy]our |[Ii]nsert |[Ee]nter |object O)")),
    ("%", re.compile(r"%[%A-Z]|<%")),
    ("<<", re.compile(r"<<")),
    ("@@", re.compile(r"@@")),
    ("##", re.compile(r"##[A-Za-z]")),
    ("_", re.compile(r"__[A-Z]|XX_")),
    ("undefined undefined", re.compile("undefined")),
    ("null null", re.compile("null")),
]
_FENCE = re.compile(r"^```.*?(?:^```[^\n]*$|\Z)", re.M | re.S)
_SPAN = re.compile(r"``[^\n]*?``|`[^`\n]*`")
_DATA = re.compile(r"^\s*[\[{].*[\]}],?\s*$")

# Words of messages by what they say, in the languages of the corpus: no phrases, since messages are worded in many ways.
# A word ending in ``*`` stands for all words that begin so, ``_`` for a blank.
CONCEPTS = {
    "object": "page* website* site seite* página* pagina* sidan strona stronę strony страниц* 页面 网页 ページ サイト document* dokument* file files datei* fichier* archivo* arquivo* bestand plik* filen файл* 文件 ファイル article* artikel* artículo* artigo* articol* artykuł* стать* item* product content* inhalt* contenu* contenido* conteúdo* contenut* inhoud* innehåll* treść treści контент* 内容 コンテンツ resource* ressource* recurso* risors* url* link address* adresse* dirección* endereço* indirizz* adres* адрес* 地址 アドレス result* ergebnis* résultat* resultad* risultat* resultat* wynik* результат* 结果",
    "not": "not no cannot can't couldn't isn't doesn't don't didn't wasn't aren't won't unable nothing nicht kein* nichts ne n' pas aucun* plus impossible non não sem nessun* impossibile niet geen inte ingen inget nie brak не нет нельзя 不 未 没 无 找不到 ない ません なし",
    "found": "found find* locat* exist* available availability displayed shown loaded moved gone geladen chargé* cargad* carregad* caricat* laddas załadow* загру* 加载 読み込 gefunden finden existier* verfügbar* erreichbar* vorhanden trouv* disponible* accessible* encontr* encuentr* existe* disponível disponíveis trovat* esist* disponibil* gevonden vinden bestaat beschikbaar* hittad* hittas hitta finns existerar tillgänglig* znalezion* znaleźć istniej* dostępn* найд* существу* доступн* доступен 找到 存在 可用 見つか 見付か 利用",
    "missing": "introuvable* inexistant* unavailable indisponível indisponíve* indisponible* inexistente* nieznalezion* niedostępn* недоступ* 找不到 不存在 no_longer_available no_longer_exists",
    "removed": "removed deleted suspended gelöscht entfernt supprimé* eliminad* removid* rimoss* eliminat* verwijderd borttag* raderad* usunięt* удален* удалён* 删除 削除",
    "error": "error errors oops fehler* erreur* erro erros errore* errori fout fouten fel błąd* błęd* ошибк* 错误 出错 エラー wrong failed failure misgegaan mis schiefgelaufen",
    "server": "server* service gateway* dienst* serveur* servidor* servicio serviço serviz* tjänst* serwer* usług* сервер* сервис* 服务 サーバ サービス database* datenbank* données datos dados databas* application anwendung* aplicación aplicação applicazion* applicatie aplikacj* приложени* 应用 アプリ",
    "happened": "occurred happened went encountered aufgetreten passiert survenu* produite produit producido ocurrido ocorreu verificat* opgetreden inträffat uppstod uppstått wystąpił* произошл* 发生 発生 establishing",
    "down": "down unavailable busy maintenance offline overloaded timed_out time-out timeout wartung* indisponible* indisponíve* mantenimiento manutenção manutenzione onderhoud* underhåll* konserwac* techniczn* технически* обслуживани* 维护 超时 メンテナンス タイムアウト",
    "retry": "try_again try_later retry again_later later again back_soon back_shortly be_back reload refresh später erneut gleich_wieder réessay* plus_tard más_tarde inténtelo intente mais_tarde tente riprova* più_tardi probeer opnieuw försök senare spróbuj później попробуйте позже 稍后 重试 後で しばらく 時間をおいて 再度",
    "access": "access permission* authoriz* authoris* zugriff* zugang* berechtig* accès autorisation* acceso* permiso* acesso* permiss* accesso* autorizzaz* toegang* åtkomst* behörighet* dostęp* uprawnie* доступ* прав 访问 权限 アクセス 権限",
    "visitor": "ip address account session* request login sitzung* sesión sessão sessione sessie* sesja сеанс* сесси* 会话 セッション",
    "denied": "denied forbidden blocked banned restricted refused expired rejected verweigert verboten gesperrt abgelaufen refusé* interdit* bloqué* expiré* denegad* prohibid* bloquead* caducad* negad* proibid* expirou negat* vietat* bloccat* scadut* geweigerd verboden geblokkeerd verlopen nekad* förbjud* blockera* odmow* zabronion* zablokowan* wygas* запрещ* закрыт* заблокирован* истек* истёк 拒绝 禁止 过期 拒否 期限切れ 受限",
    "many": "too_many rate_limit* limit_exceeded zu_viele trop_de demasiad* a_mais troppe troppi te_veel för_många zbyt_wiele zbyt_dużo слишком_много 过多 太多 多すぎ slow_down",
    "request": "requests request anfrage* requête* solicitud* peticion* pedidos solicitaç* richiest* verzoek* förfrågning* begär* żąda* zapyta* запрос* 请求 リクエスト",
    "script": "javascript* java_script script scripts skript* скрипт* 脚本 スクリプト",
    "enable": "enable* turn* switch* allow* activat* require* need* must disabled off blocked unsupported aktivier* einschalt* benötigt* erforderlich deaktiviert activ* autoris* désactiv* nécess* requis* habilit* desactiv* necesit* requiere* ativ* precis* requer* desativ* abilit* attiv* disabilit* richied* schakel* inschakel* vereist nodig uitgeschakeld aktiver* kräv* behöv* inaktiver* włącz* wymag* wyłącz* включ* необходим* требу* отключ* 启用 开启 需要 禁用 有効 必要 無効",
    "browser": "browser* navigateur* navegador* webbläsare* przeglądark* браузер* 浏览器 ブラウザ",
    "old": "out_of_date outdated support* upgrade* update* checking veraltet* obsolèt* obsolet* verouderd* föråldra* przestarzał* устарел* 过时 古い überprüf* vérifi* comprob* verific* controle* kontroll* sprawdz* провер* 检查 確認",
    "human": "human humans robot robots mensch humain* humano* umano mens människa człowiek* человек* 人机 机器人 ロボット 人間",
    "verify": "verify verif* prove confirm* complete are_you bestätig* vérifi* demuestr* dimostr* bevestig* bekräft* potwierdź подтвердите 验证 確認",
    "challenge": "captcha ddos_protection please_wait_while just_a_moment one_moment_please",
    "wait": "loading please_wait redirecting",
    "copy": "text copy caption* title* headline* heading* description* image* paragraph* content* texto* texte* testo tekst* titel* título* titre* titolo заголов* текст* 文本 文字 标题 テキスト 見出し 文章",
    "stand-in": "here placeholder* sample dummy replace* to_edit edit_this in_this_box in_this_block add_a add_your type_something lorem supplied to_be_added to_come layout_purposes filler platzhalter* beispieltext* blindtext* mustertext* exemple remplace* ejemplo reemplac* relleno exemplo substitua esempio segnaposto sostitu* voorbeeld* vervang* exempel* platshållar* przykład* zastąp* пример* замените 占位 示例 替换 サンプル ダミー",
}
#: What a message says: each a set of concepts that stand in one short line. ``code``: an HTTP error number.
RULES = [
    "object not found",
    "object missing",
    "object removed",
    "visitor removed",
    "missing code",
    "error code",
    "error server",
    "error happened",
    "error retry",
    "code not found",
    "code server",
    "code access",
    "code denied",
    "server down",
    "server missing",
    "down retry",
    "missing retry",
    "server not found",
    "access denied",
    "visitor denied",
    "access not",
    "many request",
    "many retry",
    "script enable",
    "script browser",
    "script not",
    "browser old",
    "human verify",
    "challenge",
    "copy stand-in",
]
_NAMES = {name: 1 << k for k, name in enumerate((*CONCEPTS, "code"))}
_RULES = [sum(_NAMES[c] for c in rule.split()) for rule in RULES]
_LATIN = 1 << 40
#: What makes a line worth a closer look whatever its concepts say together.
_ALONE = _LATIN | _NAMES["wait"]
_CODE = re.compile(r"(?<![\w.,-])[45]\d\d(?![\w.,-]*\w)")
_STOP = re.compile(r"[.!?…](?=\s+\S)|[。！？](?=.)")
_ONLY = re.compile(r"(?:loading|please wait|redirecting)(?:\.{1,3}|…)?$")
_AUTOMATON: list = []


def _automaton():
    """One automaton of all words of concepts and the longer filler words; built once per worker."""
    if not _AUTOMATON:
        import ahocorasick

        words: dict[str, tuple[int, bool, int]] = {}  # word: (concepts, whole, length)
        for name, text in CONCEPTS.items():
            for w in text.split():
                bare = w.rstrip("*").replace("_", " ")
                bits, whole = words.get(bare, (0, True, 0))[:2]
                words[bare] = (bits | _NAMES[name], whole and not w.endswith("*") and not _CJK.search(bare) and bare[-1] != "'", len(bare))
        for w in LOREM:
            if len(w) > 5 and w not in words:
                words[w] = (_LATIN, True, len(w))
        a = ahocorasick.Automaton()
        for w, value in words.items():
            a.add_word(w, value)
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def _concepts(lower: str) -> list[tuple[int, int]]:
    """(place, concepts) of the words of a text in lower case."""
    out = []
    n = len(lower)
    for end, (bits, whole, size) in _automaton().iter(lower):
        start = end + 1 - size
        first = lower[start]
        if first < "\u3040":  # words that are written apart
            if start and lower[start - 1].isalpha():
                continue
            if whole and end + 1 < n and lower[end + 1].isalpha():
                continue
        out.append((end, bits))
    return out


# Words of the customary Latin filler (fixed list).
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_LONG_FILLER = sorted(w for w in LOREM if len(w) > 5)
#: Words of a line that may be a message, and of prose that may stand beside messages.
MESSAGE_WORDS = 26
#: Characters of a line that may be a message.
LONGEST = 260
_WORDS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)」』*_]*\s*$")


def _count(line: str) -> int:
    """Words of a line; two CJK characters count as one word."""
    cjk = len(_CJK.findall(line))
    return len(_WORDS.findall(_CJK.sub(" ", line) if cjk else line)) + cjk // 2


def _bare(line: str) -> str:
    """A line without the marks and blanks around it."""
    rest = None
    while rest != line:
        rest, line = line, line.lstrip().lstrip("#>*_-").rstrip().rstrip("*_")
    return line


def is_filler(line: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(line)]
    return len(words) >= 4 and sum(w in LOREM for w in words) >= 0.8 * len(words)


@lru_cache(maxsize=65536)
def _says(said: int) -> bool:
    """Whether these concepts, all of them together, say what a message says."""
    return any(said & r == r for r in _RULES)


def is_message(line: str, said: int | None = None) -> bool:
    """Whether a line is, as a whole, an error message, a demand for scripts, or filler. ``said``: the concepts of its
    words."""
    if said is not None and not said & _ALONE and not _says(said | _NAMES["code"]):
        return False
    bare = _bare(line).lower().replace("’", "'")
    if said is None:
        said = 0
        for _, bits in _concepts(bare):
            said |= bits
    if not said:
        return False
    if said & _LATIN and is_filler(line):
        return True
    if len(bare) > LONGEST:
        return False
    if _CODE.search(bare):
        said |= _NAMES["code"]
    if said & _NAMES["wait"] and _ONLY.match(bare):
        return True
    if not _says(said) or _count(bare) > MESSAGE_WORDS or _QUOTED.search(bare):
        return False
    if not _STOP.search(bare):
        return True
    # what is said must be said in one sentence
    sentences = []
    for part in _STOP.split(bare):
        said = _NAMES["code"] if _CODE.search(part) else 0
        for _, bits in _concepts(part):
            said |= bits
        sentences.append(said)
    return any(map(_says, sentences))


def _some_filler(lower: str) -> bool:
    for w in _LONG_FILLER:
        if w in lower:
            return True
    return False


def message_lines(content: str) -> set[int]:
    """Numbers of the lines that are messages."""
    lines = content.split("\n")
    # a long line can only be filler
    long = [no for no, x in enumerate(lines, 1) if len(x) > LONGEST and len(_bare(x)) > LONGEST] if len(content) > LONGEST else []
    out = {no for no in long if _some_filler(lines[no - 1].lower()) and is_message(lines[no - 1])}
    short = content
    if long:
        rest = lines[:]
        for no in long:
            rest[no - 1] = ""
        short = "\n".join(rest)
    lower = short.lower().replace("’", "'")
    if len(lower) != len(short):  # rare letters whose lower case is longer: places would not fit
        return {no for no, line in enumerate(lines, 1) if is_message(line)}
    hits: dict[int, int] = {}
    at, line = 0, 1
    for end, bits in _concepts(lower):
        line += lower.count("\n", at, end)
        at = end
        hits[line] = hits.get(line, 0) | bits
    return out | {no for no, said in hits.items() if is_message(lines[no - 1], said)}


_QUOTED = re.compile(r"['\"‘“„«`][^'\"’”“»`]{3,60}['\"’”»`].*\w.*\w")


def placeholder_lines(content: str) -> set[int]:
    """Numbers of the lines with an unfilled placeholder in prose or title."""
    if not any(c in content and begins.search(content) for c, begins in _BEGINNINGS) or not PLACEHOLDER.search(content):
        return set()
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    text = _SPAN.sub(blank, _FENCE.sub(blank, content))
    return {no for no, x in enumerate(text.split("\n"), 1) if PLACEHOLDER.search(x) and not _DATA.match(x)}


#: What a line is to the decision.
OTHER, PROSE, MESSAGE, PLACE = 0, 1, 2, 3


def weighed(content: str) -> list[tuple[int, int]] | None:
    """(kind, words) of each line of a record, or None if no line may be evidence."""
    messages, places = message_lines(content), placeholder_lines(content)
    if not messages and not places:
        return None
    out = []
    fenced = False
    for no, line in enumerate(content.split("\n"), 1):
        s = line.strip()
        fence = s.startswith("```")
        fenced ^= fence
        if no in places:
            out.append((PLACE, 1))
        elif fence or not s:
            out.append((OTHER, 0))
        elif fenced or _DATA.match(s):
            out.append((PROSE, _count(s)))
        elif no in messages:
            out.append((MESSAGE, max(1, _count(s))))
        elif _ENDS.search(s) and (n := _count(s)) >= 6:
            out.append((PROSE, n))
        else:
            out.append((OTHER, 0))
    return out


#: Messages must have at least this share of the words of messages and prose, or leave fewer words of prose than make a
#: text.
SHARE = 0.4
LEAST = 25


def _outweighs(said: int, prose: int) -> bool:
    return said > 0 and (said >= SHARE * (said + prose) or prose < LEAST)


def is_residue(content: str | None, furniture: Callable[[str], frozenset[int]] = lambda _: frozenset()) -> bool:
    """Whether a record is a case as far as it shows by itself, without the counts of its host. ``furniture`` gives the
    numbers of lines that a model takes for furniture: they are no prose; evidence is subtracted by counts only."""
    if not content or not content.strip():
        return False
    lines = weighed(content)
    return lines is not None and is_case(lines, furniture(content))


def is_case(lines: list[tuple[int, int]], gone: frozenset[int] = frozenset()) -> bool:
    """Whether the weighed lines of a record, without the prose of those numbered ``gone``, make it a case."""
    if any(kind == PLACE for kind, _ in lines):
        return True
    said = sum(n for kind, n in lines if kind == MESSAGE)
    return _outweighs(said, sum(n for no, (kind, n) in enumerate(lines, 1) if kind == PROSE and no not in gone))


#: Characters of sentences (a CJK character counts three) that make a record one with content of its own.
FULL = 300
#: Hosts on which a line must stand to be boilerplate everywhere.
HOSTS = 6
ASSESSED = T.StructType(
    [
        T.StructField("scrape_id", T.LongType()),
        T.StructField("ingested_at", T.TimestampNTZType()),
        T.StructField("tie", T.LongType()),
        T.StructField("site", T.StringType()),
        T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("full", T.BooleanType()),
        T.StructField("kinds", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.ArrayType(T.IntegerType())),
    ]
)


def _full(content: str, lines: list[tuple[int, int]] | None) -> bool:
    """Whether a record has content of its own: sentences that are no evidence."""
    got = 0
    for no, line in enumerate(content.split("\n")):
        if len(line) < 10 or lines is not None and lines[no][0] == MESSAGE:
            continue
        s = line.rstrip("\"'”’»)」』）*_ \t\r")
        if s and s[-1] in ".!?…。！？":
            n = len(s) if s.isascii() or s[-1] in ".!?…" else 3 * len(s)
            got += n if n >= 28 else 0
            if got >= FULL:
                return True
    return False


def described_as(df: DataFrame) -> list[Column]:
    """Whether a record is not blank, and the columns of ASSESSED after the id that need no look at its lines."""
    blank = F.trim("content") == ""
    hashes = F.when(~blank, line_hashes(F.col("content")))
    return [(~blank).alias("some"), F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"), F.xxhash64("content").alias("hash"), site(F.col("metadata.source_url"), F.col("final_url")).alias("site"), hashes.alias("hashes")]


def assessed(df: DataFrame) -> DataFrame:
    """One row an id: the site, the hash of each line, whether it has content of its own, and for records with any
    evidence the kind and the words of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(5).to_pylist()
            yield with_evidence(batch.columns[:5], contents, [weighed(c) for c in contents])

    rows = df.where("trim(content) <> ''").select("scrape_id", *described_as(df)[1:], "content")
    return latest(rows.mapInArrow(run, ASSESSED))


def with_evidence(columns: list[pa.Array], contents: list[str], weights: list[list[tuple[int, int]] | None]) -> pa.RecordBatch:
    """Rows of ASSESSED: its first five columns, and the others by the contents and their weighed lines."""
    full = [_full(c, lines) for c, lines in zip(contents, weights)]
    kinds, words = ([lines and [x[k] for x in lines] for lines in weights] for k in (0, 1))
    return pa.RecordBatch.from_arrays([*columns, pa.array(full, pa.bool_()), pa.array(kinds, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))], names=ASSESSED.names)


def latest(rows: DataFrame) -> DataFrame:
    """One row an id of rows of ASSESSED: its latest delivery."""
    rest = ["site", "hashes", "full", "kinds", "words"]
    return rows.groupBy("scrape_id").agg(F.max_by(F.struct(*rest), F.struct("ingested_at", "tie")).alias("r")).select("scrape_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def boilerplate(recs: DataFrame, min_records: int = MIN_RECORDS, one_in: int = ONE_IN, hosts: int = HOSTS) -> tuple[DataFrame, DataFrame]:
    """(site, hash) of the lines that recur on their host, and (hash) of those that recur on several hosts: most of
    their records have content of their own."""
    known = recs.where("site IS NOT NULL")
    sizes = known.groupBy("site").agg(F.count("*").alias("site_records"))
    lines = known.select("site", "full", F.explode(F.array_distinct("hashes")).alias("hash")).where("hash IS NOT NULL")
    per = lines.groupBy("site", "hash").agg(F.count("*").alias("n"), F.count_if("full").alias("own"))
    most = F.col("own") * 2 >= F.col("n")
    # a site's size goes to parts of the site, so that a large one does not meet in one task
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    local = per.where((F.col("own") >= min_records) & most).withColumn("salt", F.pmod("hash", F.lit(SALT)).cast("int")).join(salted, ["site", "salt"])
    local = local.where(F.col("own") * one_in >= F.col("site_records")).select("site", "hash")
    general = per.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.count_if(F.col("own") > 0).alias("hosts")).where((F.col("hosts") >= hosts) & most).select("hash")
    return local, general


#: Parts of each site in the join with its size.
SALT = 32


def found(df: DataFrame, min_records: int = MIN_RECORDS, one_in: int = ONE_IN, hosts: int = HOSTS) -> DataFrame:
    """scrape_id of the records that are cases."""
    return found_in(assessed(df), min_records, one_in, hosts)


def found_in(recs: DataFrame, min_records: int = MIN_RECORDS, one_in: int = ONE_IN, hosts: int = HOSTS) -> DataFrame:
    """``found`` of assessed records."""
    recs = cut(recs)
    local, general = boilerplate(recs, min_records, one_in, hosts)
    lines = recs.where("kinds IS NOT NULL").select("scrape_id", "site", F.explode(F.arrays_zip("hashes", "kinds", "words")).alias("x")).select("scrape_id", "site", "x.*").where(f"kinds <> {OTHER}")
    left = lines.join(local.select("site", F.col("hash").alias("hashes"), F.lit(True).alias("local")), ["site", "hashes"], "left").join(general.select(F.col("hash").alias("hashes"), F.lit(True).alias("general")), "hashes", "left").where("local IS NULL AND general IS NULL")
    words = lambda kind: F.sum(F.when(F.col("kinds") == kind, F.col("words")).otherwise(0))
    sums = left.groupBy("scrape_id").agg(words(MESSAGE).alias("said"), words(PROSE).alias("prose"), words(PLACE).alias("places"))
    return sums.where((F.col("places") > 0) | (F.col("said") > 0) & ((F.col("said") >= SHARE * (F.col("said") + F.col("prose"))) | (F.col("prose") < LEAST))).select("scrape_id")


def p5_found(spark, sf):
    """scrape_id of template residue, filler, errors and demands for scripts."""
    return found(scrapes(spark, sf))
