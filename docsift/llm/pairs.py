"""Problem 3: question and answer pairs whose answer is no answer.

Each answer whose question exists gets at most one defect, the first that holds:

* ``empty``: null, blank, only mark-up, punctuation or a placeholder;
* ``copied``: greedy string tiling covers the answer with pieces of the question;
* ``refusal``: every sentence that isn't a courtesy matches a refusal rule;
* ``language``: function words and scripts name another language than the
  question's, and the question does not ask for a word of that language;
* ``truncated``: a pushdown parser finds an open fence, bracket, quotation or
  tag, or the last sentence has no end.  Whether a lone phrase is a sentence
  that lacks its end is decided by statistics over all answers: how often
  sentences with its opening words end properly, and whether its last word is
  only the beginning of words that occur elsewhere.

Defined results: null and empty answers are ``empty``; a null question with an
existing key has no language and nothing to copy; a null or unknown query key
gives no row; answers sent twice count once; empty tables give an empty result.
Only the named columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.words import by_batch
from docsift.stage import Stage

# ---- empty -------------------------------------------------------------------

_TAG = re.compile(r"<!--.*?(?:-->|$)|</?[A-Za-z][^<>]*>|&(?:nbsp|amp|lt|gt|quot|#\d+);|^\s*```\w*\s*$", re.S | re.M)
#: Words that stand for a missing answer.
_PLACEHOLDER = re.compile(
    r"(?:n\W?a|null|nil|nan|none|undefined|tbd|tba|tbc|todo|to do|to be (?:done|determined|defined|completed|added)|xxx+|placeholder|empty|blank|answer|"
    r"answer (?:here|goes here|text|pending)|insert answer(?: here)?|your answer(?: here)?|no text|no content|missing|pending|lorem ipsum|string|text|response|output|"
    r"keine angabe|k a|leer|vide|vacío|sin respuesta|néant|无|空|暂无|待定|なし|未定|未入力|空白)"
)


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, mark-up, punctuation or a placeholder."""
    if text is None:
        return True
    bare = re.sub(r"[\W_]+", " ", _TAG.sub(" ", text)).strip().lower()
    return not bare or _PLACEHOLDER.fullmatch(bare) is not None


# ---- tokens and tiling ---------------------------------------------------------

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Words, and single characters of Chinese and Japanese, in lower case."""
    return _TOKEN.findall(text.lower()) if text else []


def tile(answer: list[str], question: list[str], least: int = 2) -> list[bool]:
    """Which tokens of the answer lie in tiles of the question, longest tiles first.

    A question may be used again once no tile of ``least`` tokens is left, so a
    question repeated twice is covered too.
    """
    covered = [False] * len(answer)
    starts: dict[str, list[int]] = {}
    for j, w in enumerate(question):
        starts.setdefault(w, []).append(j)
    while True:
        used = [False] * len(question)
        any_tile = False
        while True:
            best, found = least - 1, []
            for i, w in enumerate(answer):
                if covered[i]:
                    continue
                for j in starts.get(w, ()):
                    k = 0
                    while i + k < len(answer) and j + k < len(question) and answer[i + k] == question[j + k] and not covered[i + k] and not used[j + k]:
                        k += 1
                    if k > best:
                        best, found = k, [(i, j)]
                    elif k == best and k >= least:
                        found.append((i, j))
            if not found:
                break
            for i, j in found:
                if not any(covered[i : i + best]) and not any(used[j : j + best]):
                    covered[i : i + best] = [True] * best
                    used[j : j + best] = [True] * best
                    any_tile = True
        if not any_tile:
            return covered


#: Words that introduce a repeated question.
_FRAME = set("question answer q a you asked ask your is was the in short frage antwort sie fragten réponse vous demandez pregunta respuesta usted preguntó 问 答 问题 質 問 题 題 回".split())


def is_copied(answer: str, question: str | None) -> bool:
    """The answer only repeats the question, once or more."""
    a, q = tokens(answer), tokens(question)
    if len(q) < 2 or len(a) < 2:
        return False
    if a == q:
        return True
    known = set(q) | _FRAME
    if sum(w not in known for w in a) > 0.1 * len(a):
        return False
    covered = tile(a, q)
    rest = [w for w, c in zip(a, covered) if not c and w not in _FRAME]
    kept = [j for j in range(len(q))]
    reach = sum(tile(q, a))
    return len(rest) <= 0.1 * len(a) and reach >= 0.8 * len(kept) and not re.search(r"[:：]\s*\S+\s+\S+\s+\S", re.sub(re.escape(question or ""), "", answer, flags=re.I))


# ---- languages -----------------------------------------------------------------

#: Function words, question words and frequent verbs of each language.
_CUES = {
    "en": "the of and is are was were be been to in on at by for with from that this which who what when where why how does do did not it its an a has have had than then when if each more less between before after while once "
    "because stands mean means meaning define explain list role types difference steps value applies needed happens called they can may must there either both only same into or as all any no unlike without used called",
    "de": "der die das des dem den und ist sind war wird werden wurde ein eine einer eines einem einen nicht mit von zu zum zur bei für auf aus im am als auch sich nach vor durch wenn dann oder aber wie was wer wann warum wozu welche welcher welches "
    "jede jeder jedes muss kann man hier gilt zwischen mehr sobald damit ohne nur regel reicht dient zusammen hängt braucht besteht misst liegt erneut bleibt wäre ihre ihr es heißt nennt manchmal",
    "fr": "le la les un une des du de et est sont était sera qui que quoi quel quelle quels quelles quand pourquoi comment où dans sur sous avec sans pour par pas ne plus au aux ce cette ces il elle on se sa son ses chaque puis dès si alors entre avant après "
    "faut sert lien trouve reste prend relais mesure faite fait doit être delà essai à qu l d c n pièce appelle parfois ou",
    "es": "el la los las un una unos unas del de y es son era está se que qué cuál cuáles cuándo cuando cómo por para con sin no más al lo su sus esta este cada luego tras si entonces entre antes después hay hace falta sirve queda deja debe ser aquí capa "
    "vale general basta sobre hasta tiene dice llama también o pieza importante",
}
_CUE_SETS = {k: set(v.split()) for k, v in _CUES.items()}
_LETTERS = {"de": re.compile(r"[äöüß]"), "fr": re.compile(r"[çœêèëîïôûùæ]|\b(?:[ldcnsjm]|qu)['’]"), "es": re.compile(r"[ñ¿¡]|[áíóú]")}
_KANA, _HAN = re.compile(r"[぀-ヿㇰ-ㇿ]"), re.compile(r"[㐀-鿿豈-﫿]")
#: How each language is called in the six languages.
_NAMES = {
    "en": "english englisch englischen anglais inglés 英语 英文 英語",
    "de": "german deutsch deutschen allemand alemán 德语 德文 ドイツ語",
    "fr": "french französisch französischen français francés 法语 法文 フランス語",
    "es": "spanish spanisch spanischen espagnol español castellano 西班牙语 西班牙文 スペイン語",
    "zh": "chinese chinesisch chinesischen chinois chino 中文 汉语 中国語",
    "ja": "japanese japanisch japanischen japonais japonés 日语 日文 日本語",
}


def language(text: str | None, least: float = 2.0) -> str | None:
    """en, de, fr, es, zh or ja; None if the text is too short or mixed to tell."""
    if not text:
        return None
    kana, han, latin = len(_KANA.findall(text)), len(_HAN.findall(text)), len(re.findall(r"[A-Za-zÀ-ɏ]", text))
    if kana + han >= 2 and (kana + han) * 2 >= latin:
        return "ja" if kana * 10 >= han else "zh"
    low = text.lower()
    ws = re.findall(r"[^\W\d_]+", low)
    scores = {k: float(sum(w in s for w in ws)) for k, s in _CUE_SETS.items()}
    for k, p in _LETTERS.items():
        scores[k] += 0.8 * len(p.findall(low))
    ranked = sorted(scores.items(), key=lambda x: -x[1])
    (best, top), (_, second) = ranked[0], ranked[1]
    return best if top >= least and top >= 1.5 * second and top >= 0.12 * len(ws) else None


def wrong_language(answer: str, question: str | None) -> bool:
    """The answer is in another language than the question, which doesn't ask for it."""
    asked, given = language(question, 1.0), language(answer)
    if not asked or not given or asked == given:
        return False
    q = (question or "").lower()
    return not any(n in q for n in _NAMES[given].split())


#: A sentence longer than this is no refusal; it keeps rules from running over very long texts.
LONGEST_REFUSAL = 500

# ---- refusals --------------------------------------------------------------------

_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)]*\s*|\n+")
#: Courtesies that may stand around a refusal.
_COURTESY = re.compile(
    r"(?:hello|hi|hey|dear user|thanks?(?: you)?(?: for [^.!?]*)?|good (?:morning|afternoon|day|question)|(?:my|our|sincere|please accept my) apolog(?:y|ies)|apologies|i apologi[sz]e(?: for [^.!?]*)?|sorry|so sorry|unfortunately|i am sorry|i'm sorry|i’m sorry|"
    r"(?:please|kindly|you (?:may|can|could|might)|try|feel free|perhaps|maybe)\b[^.!?]*\b(?:try|ask|upload|rephras|contact|consult|provid|check|select|search|question|help|refer)[^.!?]*|is there anything else[^.!?]*|let me know[^.!?]*|how (?:else )?can i help[^.!?]*|"
    r"hallo|guten tag|entschuldigung|verzeihung|es tut mir leid|tut mir leid|leider|bitte[^.!?]*|bonjour|désolée?|je suis désolée?|veuillez[^.!?]*|merci[^.!?]*|hola|lo siento|perdón|disculpe|por favor[^.!?]*|"
    r"你好|您好|抱歉|很抱歉|对不起|请[^。！？]*|すみません|申し訳ありません|申し訳ございません|恐れ入りますが[^。！？]*|[^。！？]*してください|もう一度[^。！？]*)[,，、 ]*[.!?。！？]*",
    re.I,
)
_LEAD = (
    r"(?:(?:hello|hi|well|ok(?:ay)?|(?:i am|i'm|i’m|we are|we're)?\s*(?:very |so |really |truly |terribly )?sorry|(?:my )?apologies|unfortunately|regrettably|sadly|alas|i(?:'m|’m| am) afraid(?: that)?|as an?\b[^.,]{0,40}|at this time|for (?:safety|policy|legal) reasons|but|that|and|currently)[,!:–— ]+)*"
)
_ABLE = r"(?:can ?not|can['’]t|could not|couldn['’]t|(?:am|are|is|was|were|['’]m|['’]re) (?:currently |just )?(?:unable|not able|not allowed|not permitted|not in a position)|will not|won['’]t|would rather not|must (?:respectfully )?decline|have to decline|decline|refuse|must refuse|do not|don['’]t|did not|didn['’]t|have no|has no|found no(?:thing)?|found none|know nothing|am not sure|['’]m not sure|see no|lack|have nothing|has nothing|never)"
_DO = r"(?:answer|help|assist|respond|reply|comment|provide|give|offer|find|locate|determine|say|tell|share|discuss|supply|identify|comply|know|have|see|fulfil|process|access|support|address|retrieve|produce|explain|speak|advise|generate|complete|do (?:that|this))"
_SOURCE = r"(?:(?:uploaded|selected|provided|given|available|retrieved|chosen|attached|present|your|indexed|supplied|these|those|this|the|my|our|any|all) )*(?:files?|documents?|sections?|pages?|texts?|passages?|sources?|materials?|context|excerpts?|collection|corpus|records?|uploads?|library|information|database|knowledge base|content)"
_THING = r"(?:passages?|sections?|answers?|information|results?|match(?:es)?|documents?|texts?|content|evidence|data|reference|mention|details?|hits?|sources?|material|explanation|statement|response|entry|entries|pages?)"
_REFUSAL = {
    "en": re.compile(
        rf"{_LEAD}(?:"
        rf"(?:i|we|this assistant|the assistant|the system)\s?{_ABLE}(?: (?:to|be able to|currently|really|any|an|the|enough|sufficient|possibly|reliably))*(?: {_DO}\b| know\b| (?:answer|information|access|data|details|knowledge|idea|record|way|material|context|opinion|passage|anything|about|on|in|for)\b|[.!,]|$)[^.!?]*"
        rf"|(?:could not|couldn['’]t|can ?not|can['’]t|unable to|not able to|failed to|did not|didn['’]t) {_DO}\b[^.!?]*"
        rf"|(?:there (?:is|was|are|were|seems to be|appears to be) )?(?:no|not any|insufficient|not enough|too little|hardly any|zero) (?:\w+ ){{0,3}}{_THING}\b(?! (?:reads|exceeds|shows|needs|carries|holds))(?: (?:to|was|were|is|are|could|can|has|have|found|available|possible|on|about|for|here|in|exists?|that|which|matched|matches|regarding|concerning|from|provided|given)\b[^.!?]*)?"
        rf"|(?:there (?:is|was) )?(?:nothing|none|not a word)(?: (?:relevant|useful|suitable|similar|like that|at all|helpful))?(?: (?:in|of|from|among|within) {_SOURCE})?(?: (?:was|could be|has been|is|were))?(?: (?:found|deals? with|says?|mentions?|covers?|refers? to|relates? to|answers?|about|matche[sd]|describes?|explains?|addresses|on|available|discusses|known))\b[^.!?]*"
        rf"|{_SOURCE}(?: (?:you|we|i) (?:uploaded|selected|provided|chose|have|gave))? (?:say|says|contain|contains|mention|mentions|provide|provides|include|includes|hold|holds|offer|offers|give|gives|have|has|cover|covers|reveal|state|states) (?:nothing|no |not |none|neither)[^.!?]*"
        rf"|{_SOURCE}(?: (?:you|we|i) (?:uploaded|selected|provided|chose|have|gave))? (?:do(?:es)?|did) ?(?:not|n['’]t) (?:say|contain|mention|cover|address|answer|include|provide|specify|discuss|hold|state|give|describe|seem|appear|deal|refer|explain|offer|have)[^.!?]*"
        rf"|(?:this|that|the|your|such an?) (?:question|query|request|topic|subject)s?(?: \w+)? (?:can ?not|can['’]t|could not|couldn['’]t|is (?:not|beyond|outside|out of)|falls outside|lies outside|goes beyond|remains unanswered|has no answer)[^.!?]*"
        rf"|(?:it|this|that)(?: is| was|['’]s) (?:not (?:something|possible|clear|known|stated|mentioned|covered|specified|a question|a topic|available)|impossible|beyond|outside|out of)[^.!?]*"
        rf"|(?:it is |it's )?(?:not|n['’]t) (?:found|known|stated|available|specified|mentioned|answerable|covered)(?: (?:in|by|from) [^.!?]*)?"
        rf"|(?:it|this|that) (?:is|would be|goes|would go|runs) (?:against|contrary to|outside|beyond) (?:my|our|the) [^.!?]*|(?:my|our) (?:guidelines|rules|policy|policies|instructions|programming|settings) (?:do not|don['’]t|does not|doesn['’]t|forbid|prevent|prohibit|keep|stop|rule out)[^.!?]*"
        rf"|(?:i|we)(?:['’]d| would| should)? (?:prefer|rather|choose|wish|opt) not(?: to)? [^.!?]*|(?:i|we) (?:am|are|['’]m|['’]re) (?:forbidden|prohibited|barred|prevented) [^.!?]*"
        rf"|(?:the )?answer (?:is |was |could |can)?(?: ?not|not be|isn['’]t|unknown|unavailable)[^.!?]*|(?:i|we) have (?:no|not)[^.!?]*|(?:no idea|i wouldn['’]t know|unknown|not sure)(?:[^.!?]{{0,30}})?|request (?:denied|refused|declined|rejected)[^.!?]*"
        rf")(?:,? (?:i['’]m afraid|i am afraid|sorry|unfortunately))?[.!?]*",
        re.I,
    ),
    "de": re.compile(
        r"(?:(?:es )?tut mir leid|entschuldigung|leider|bedauerlicherweise|verzeihung|hallo|aber|dass|als [^.,]{0,40})?[,!:–— ]*(?:(?:leider|dass) )*(?:"
        r"(?:(?:das|diese|die|dazu|darauf|hierzu|dabei|hier) )?(?:frage )?(?:kann|können|konnte|konnten|darf|möchte|vermag|werde) (?:ich|wir|man|nicht|leider|diese|die|ihre|das|dazu|dies)[^.!?]*(?:nicht|keine|nichts)[^.!?]*"
        r"|(?:ich|wir) (?:kann|können|konnte|konnten|darf|weiß|wissen|habe|haben|finde|fand|sehe|muss|bin|sind)[^.!?]*(?:nicht|keine|nichts|ablehnen|außerstande|kein)[^.!?]*"
        r"|(?:über|zu|zur|zum|darüber|dazu|hierzu|hierüber|darauf) [^.!?]{0,120}?(?:darf|kann|möchte|will|werde|könnte|soll) (?:ich|wir) [^.!?]*(?:nichts|nicht|keine\w*)[^.!?]*|(?:darüber|dazu|hierzu|hierüber|darauf) (?:darf|kann|möchte|will|werde) (?:ich|wir) [^.!?]*(?:nichts|nicht|keine\w*)[^.!?]*"
        r"|(?:ich|wir) (?:möchte|würde|will|antworte|äußere|ziehe|lehne|verweigere)[^.!?]*(?:lieber nicht|nicht|vor, nicht|\bab\b|keine)[^.!?]*|(?:es ist mir|mir ist es) (?:leider )?(?:nicht|untersagt|unmöglich|verboten)[^.!?]*"
        r"|kein(?:e|en|er)? (?:\w+ ){0,2}(?:stellen?|antwort(?:en)?|informationen?|angaben?|treffer|inhalte?|abschnitte?|passagen?|ergebnis(?:se)?|hinweise?|auskunft|textstellen?)\b[^.!?]*"
        r"|(?:dazu|darüber|hierzu|es|in [^.!?]{0,60}?)\s?(?:wurde|wurden|gibt|steht|findet|ließ|liegt|liegen|ist|konnte|enthält|enthalten)[^.!?]*(?:nichts|kein\w*|nicht (?:gefunden|beantwort|enthalten|vorhanden|möglich|zu finden))[^.!?]*"
        r"|(?:die|ihre|der|das|den) (?:\w+ )?(?:dateien?|dokumente?n?|abschnitte?n?|seiten?|texte?|auswahl|unterlagen|quellen?)[^.!?]*(?:nichts|keine?\w* (?:angaben?|informationen?|antwort|hinweise?|aussagen?|auskunft)|nicht (?:erwähn|behandel|enthalt|beantwort))[^.!?]*"
        r"|(?:diese|die|ihre) (?:frage|anfrage)[^.!?]*(?:nicht|unbeantwortet|ablehnen)[^.!?]*|nichts (?:\w+ )?gefunden[^.!?]*|nicht gefunden|eine antwort[^.!?]*nicht[^.!?]*|unbekannt"
        r")[.!?]*",
        re.I,
    ),
    "fr": re.compile(
        r"(?:(?:je suis |nous sommes )?(?:vraiment |sincèrement )?désolée?s?|malheureusement|je regrette|pardon|bonjour|hélas|mais|en tant qu[^.,]{0,40})?[,!:–— ]*(?:mais )?(?:"
        r"(?:je|nous|on) (?:ne|n['’])\s?[^.!?]*(?:pas|rien|aucune?|jamais|point)\b[^.!?]*"
        r"|(?:je|nous) (?:suis|sommes|dois|devons) [^.!?]*(?:incapable|refuser|décliner|impossible|pas en mesure)[^.!?]*"
        r"|(?:je|nous) (?:préfère|préférons|préférerais|préférerions|aimerais|choisis|souhaite) (?:de )?ne (?:pas|rien) [^.!?]*|(?:je|nous) (?:refuse|refusons|décline|déclinons|m['’]abstiens)\b[^.!?]*|il (?:m['’]est|nous est) (?:impossible|interdit|défendu)[^.!?]*"
        r"|aucune? (?:\w+ ){0,2}(?:passages?|réponses?|informations?|résultats?|sections?|documents?|extraits?|éléments?|contenus?|mention|texte|donnée)\b[^.!?]*"
        r"|rien (?:\w+ ){0,4}(?:trouvé|à ce sujet|sur|concern)[^.!?]*|(?:il est )?impossible (?:de|d['’])\s?(?:répondre|trouver|donner|fournir)[^.!?]*"
        r"|(?:les|vos|ces|ce|le|la|cette) (?:\w+ )?(?:fichiers?|documents?|sections?|pages?|textes?|passages?|sources?|extraits?|questions?)[^.!?]*\bn(?:e\s|['’])[^.!?]*(?:pas|rien|aucune?)\b[^.!?]*|il n['’]y a (?:pas|rien|aucune?)[^.!?]*|(?:réponse )?(?:introuvable|inconnue?)"
        r")[.!? ]*",
        re.I,
    ),
    "es": re.compile(
        r"(?:lo siento(?: mucho)?|lamentablemente|desafortunadamente|por desgracia|perdón|disculpe|lamento|hola|pero|como [^.,]{0,40})?[,!:–— ]*(?:pero )?(?:"
        r"no (?:puedo|podemos|sé|sabemos|tengo|tenemos|he |hemos|encuentro|encontré|encontramos|me es posible|es posible|dispongo|se encontr|se ha |se han |se pudo|se puede responder|hay (?:\w+ ){0,2}(?:información|respuestas?|datos|pasajes?|resultados?|ningun\w*|nada|suficiente|material|contenido)|existe (?:ningun\w*|información|respuesta)|estoy (?:en condiciones|autorizad\w)|consta|aparece nada)[^.!?]*"
        r"|(?:prefiero|preferimos|preferiría|elijo|opto por) no [^.!?]*|no (?:debo|quiero|deseo|me está|me es|nos es|voy a)\b[^.!?]*|(?:me|nos) (?:está|tienen) prohibido[^.!?]*|(?:rehúso|rechazo|declino)\b[^.!?]*"
        r"|ning(?:ún|una) (?:\w+ ){0,2}(?:pasaje|respuesta|información|sección|documento|resultado|texto|página|fragmento)\b[^.!?]*"
        r"|nada (?:\w+ ){0,3}(?:encontr|sobre|relevante|útil)[^.!?]*|(?:me )?(?:es|resulta) imposible (?:responder|contestar|ayudar|encontrar)[^.!?]*|(?:debo|tengo que) (?:rechazar|declinar)[^.!?]*"
        r"|(?:los|las|el|la|sus|estos|estas|este|esta) (?:\w+ )?(?:archivos?|documentos?|secciones|sección|páginas?|textos?|pasajes?|fuentes?|ficheros?|preguntas?)[^.!?]*\bno (?:contiene|mencion|dice|incluye|habl|trata|tiene|se puede|puede|ofrece)[^.!?]*|sin (?:respuesta|resultados|información)[^.!?]*|respuesta desconocida"
        r")[.!?]*",
        re.I,
    ),
    "zh": re.compile(
        r"(?:你好|您好|很?抱歉|对不起|非常抱歉|不好意思|遗憾的是|很遗憾|作为[^，。]{0,20})?[，,！!：: ]*(?:但是?)?(?:"
        r"(?:我|我们|本助手|本系统|系统)?(?:目前|暂时|现在|实在|并)?(?:无法|不能|没法|不便|不可以|拒绝|难以)(?:为您|为你|对此|就此|直接|准确)?(?:回答|提供|找到|确定|回复|帮助|帮|协助|给出|处理|作答|说明|判断|解答|查到)[^。！？]*"
        r"|(?:在?[^，。]{0,25}(?:中|里|内|上))?[，,]?(?:未|没有|没|并未|并没有|未能|没能|找不到|查不到|未曾|无|不存在|不包含|没有任何|缺少|缺乏)(?:能)?(?:找到|查到|发现|检索到|提及|提到|足够的?|相关的?|任何|有用的?|有关|匹配的?|合适的?|涉及|说明)?[^。！？]{0,25}?(?:内容|信息|答案|资料|段落|章节|结果|文档|材料|记载|说明|回答|依据|提及|涉及|找到)"
        r"|(?:我|我们|本助手)?(?:更|还是|宁愿|宁可|选择|倾向于|希望)?(?:不想|不愿意?|不打算|不方便|不便|不宜|不予|拒绝|婉拒|无权)[^。！？]{0,12}?(?:回答|回应|答复|讨论|谈论|评论|透露|说明|提供|作答|谈)[^。！？]*"
        r"|(?:根据|按照)[^。！？]{0,20}(?:规定|准则|政策|指南)[^。！？]{0,10}(?:不能|无法|不得|不可)[^。！？]*"
        r"|(?:我|我们)?(?:也)?(?:不知道|不清楚|不了解|不确定)[^。！？]{0,15}|(?:这个|此|该|这)?问题(?:无法|不能|没有办法)[^。！？]*|无可奉告"
        r")[。！？.!?]*"
    ),
    "ja": re.compile(
        r"(?:(?:大変|誠に)?申し訳(?:ありません|ございません|ない)(?:が|けど)?|すみません(?:が)?|残念ながら|恐れ入りますが|あいにく|ごめんなさい|こんにちは)?[、,。！ ]*(?:"
        r"[^。！？]{0,40}?(?:お答え|回答|返答|対応|提供|お手伝い|お役に立|ご案内|説明|判断|応じる)[^。！？]{0,12}?(?:できません|できない|できかねます|いたしかねます|出来ません|しかねます|ことはできません|ません)"
        r"|[^。！？]{0,40}?(?:見つかりません|見つかりませんでした|見当たりません|見つけられません|見つからない|見つけることができません|確認できません)(?:でした)?"
        r"|[^。！？]{0,40}?(?:情報|記載|該当|内容|答え|回答|資料|箇所|記述|言及|データ|文書)[^。！？]{0,12}?(?:ありません|ございません|ない|存在しません|含まれていません|含まれておりません|不足しています|足りません)(?:でした)?"
        r"|[^。！？]{0,60}?(?:お答え|回答|返答|コメント|言及|説明|発言)(?:は|を|については|に関しては)?(?:差し)?控え[^。！？]*|[^。！？]{0,60}?(?:申し上げ|お話し|お話)[^。！？]{0,10}(?:られません|できません|かねます)|[^。！？]{0,40}?(?:答えたく|答えない)[^。！？]*"
        r"|(?:私|わたし)?(?:に|は|には)?[^。！？]{0,12}?(?:わかりません|分かりません|存じません|知りません)"
        r")[。！？.!?]*"
    ),
}


def is_refusal(text: str) -> bool:
    """Every sentence is a courtesy or declines, and one declines."""
    parts = [p.strip(" \t\r\n\"“”«»*_") for p in re.split(r"(?<=[.!?。！？])\s*(?=\S)|\n+|;\s+", text)]
    parts = [p for p in parts if p and not re.fullmatch(r"[\W_]+", p)]
    declined = False
    for p in parts:
        if len(p) > LONGEST_REFUSAL:
            return False
        if any(r.fullmatch(p) for r in _REFUSAL.values()):
            declined = True
        elif not _COURTESY.fullmatch(p):
            return False
    return declined or (bool(parts) and all(re.fullmatch(r"(?:(?:i am|i'm|i’m|my|so|very) )*(?:sorry|apologies)\W*|抱歉\W*|很抱歉\W*|申し訳(?:ありません|ございません)\W*|lo siento\W*|désolée?\W*|(?:es )?tut mir leid\W*", p, re.I) for p in parts))


# ---- truncation --------------------------------------------------------------------

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "“": "”", "«": "»", "„": "“"}
_CLOSING = {v: k for k, v in _PAIRS.items()}
_MARKUP = re.compile(r"```|</?([A-Za-z][A-Za-z0-9]*)[^<>]*?(/?)>|[()\[\]{}（）「」『』【】《》“”«»„]|\"|`")
_VOID = {"br", "hr", "img", "input", "meta", "link", "p", "li"}


def open_at_end(text: str) -> list[str]:
    """What a pushdown parser finds open at the end: fences, tags, brackets and quotations."""
    stack: list[str] = []
    for m in _MARKUP.finditer(text):
        s = m.group()
        if stack and stack[-1] == "```":
            if s == "```":
                stack.pop()
            continue
        if s in ("```", "`", '"'):
            if s in stack:
                del stack[len(stack) - 1 - stack[::-1].index(s) :]
            else:
                stack.append(s)
        elif s[0] == "<" and m.group(1):
            tag = "<" + m.group(1).lower()
            if m.group(2) or m.group(1).lower() in _VOID:
                continue
            if s.startswith("</"):
                if tag in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            else:
                stack.append(tag)
        elif s == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif s in _PAIRS:
            stack.append(s)
        elif s in _CLOSING:
            opener = _CLOSING[s]
            if opener in stack:
                del stack[len(stack) - 1 - stack[::-1].index(opener) :]
    if re.search(r"<[A-Za-z/!][^<>]*$", text):
        stack.append("<")
    return stack


_END = re.compile(r"[.!?。！？][\"'”’»)\]）」』】*_]*$|</[A-Za-z]+>$|```$|\|$")
_CUT_MARK = re.compile(r"(?:\s*(?:…|\.{3,}|\[(?:\.{2,}|…)\]|�+))+$")
_ITEM = re.compile(r"^\s*(?:[•·*–—-]|\d{1,3}[.)]|[a-z][.)])\s+", re.M)
#: Words that can't end a phrase, beside those met only inside sentences.
_DANGLING = set(
    "the a an of and or to in on at by for with from that which is are was were be been than as because if when while between into under over per each its their der die das des dem den und oder ein eine einen einem einer mit von zu zum zur bei für auf aus im am als "
    "durch wird werden ist sind wenn le la les un une des du de et ou est sont dans sur avec pour par au aux que qui ne se sa son el los las unos unas del y o es son en con sin por para al lo su sus".split()
)


def fragment(text: str) -> str | None:
    """The unfinished last sentence of an answer, or None if the answer ends well."""
    t = text.rstrip()
    if not t or _END.search(t) and not _CUT_MARK.search(t):
        return None
    bare = _CUT_MARK.sub("", t).rstrip()
    parts = re.split(r"(?<=[.!?])[\"'”’»)]*\s+|(?<=[。！？])|\n+", bare)
    return parts[-1].strip() or None


def opening(sentence: str) -> str | None:
    """The first two tokens of a sentence, numbers as #."""
    ts = [re.sub(r"\d+", "#", t) for t in tokens(sentence)[:2]]
    return " ".join(ts) if len(ts) == 2 else None


def sentences(text: str) -> list[str]:
    """Finished sentences of a text."""
    return [p.strip() for p in re.split(r"(?<=[.!?])[\"'”’»)]*\s+|(?<=[。！？])|\n+", text) if _END.search(p.strip())]


def is_list(text: str) -> bool:
    """At least one line after the first is a list item, or all lines are."""
    lines = [x for x in text.strip().split("\n") if x.strip()]
    return len(lines) > 1 and all(_ITEM.match(x) for x in lines[1:])


def verdict(question: str | None, answer: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(defect, opening, last word, last two words): a defect, or what the statistics have to decide about a lone phrase."""
    if is_empty(answer):
        return "empty", None, None, None
    if is_copied(answer, question):
        return "copied", None, None, None
    if is_refusal(answer):
        return "refusal", None, None, None
    if wrong_language(answer, question):
        return "language", None, None, None
    t = answer.rstrip()
    opened = open_at_end(t)
    ends = bool(_END.search(t)) and not _CUT_MARK.search(t)
    if opened and (not ends or any(o == "```" or o[0] == "<" for o in opened)):
        return "truncated", None, None, None
    if _CUT_MARK.search(t):
        return "truncated", None, None, None
    if ends:
        return None, None, None, None
    last = fragment(answer)
    ws = tokens(last)
    if not ws:
        return None, None, None, None
    if t[-1] in ",;:-–—(，、；：":
        return "truncated", None, None, None
    if is_list(answer):
        return None, None, ws[-1], None
    if _KANA.search(last) or _HAN.search(last):
        return ("truncated" if len(ws) >= 8 or len(tokens(answer)) > len(ws) else None), None, None, None
    if len(ws) > 1 and ws[-1] in _DANGLING and not last[-1].isupper():
        return "truncated", None, None, None
    body = re.sub(r"^.*?\banswer:\s*|^you asked [^–—]*[–—]\s*|^in short:\s*", "", answer.strip(), flags=re.I | re.S)
    if len(sentences(body)) >= 1 and len(last) < len(body.strip()):
        return "truncated", None, None, None
    if len(ws) > 14:
        return "truncated", None, None, None
    return None, opening(last), ws[-1], " ".join(ws[-2:])


#: Last words of more than one unfinished text, and of more than this share of all texts, end phrases.
CLOSING = 1e-5
JUDGED = "answer_id long, defect string, opening string, last string, tail string, words int"
STATS = "kind string, item string, ended int, n long"


def _judge(pairs: DataFrame) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], []]
            for k, q, a in zip(*(c.to_pylist() for c in batch.columns)):
                for col, v in zip(cols, (k, *verdict(q, a), len(tokens(a)))):
                    col.append(v)
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["answer_id", "defect", "opening", "last", "tail", "words"])

        return run

    return by_batch(pairs.select("answer_id", "query_text", "answer_text"), make, JUDGED)


def _statistics(answers: DataFrame) -> DataFrame:
    """Openings of finished and unfinished sentences, words that aren't last and pairs of words that are or aren't, counted over the distinct answer texts."""

    def make():
        from collections import Counter

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            seen: Counter = Counter({("texts", "", 1): batch.num_rows})
            for a in batch.column(0).to_pylist():
                if not a:
                    continue
                for s in sentences(a):
                    if o := opening(s):
                        seen["open", o, 1] += 1
                last = fragment(a)
                if last and not is_list(a) and (o := opening(last)) and len(last) == len(a.strip()):
                    seen["open", o, 0] += 1
                ws = tokens(a)
                inner = ws if not last else ws[:-1]
                seen.update(("word", w, 1) for w in set(inner))
                seen.update(("tail", " ".join(p), 1) for p in set(zip(inner, inner[1:])))
                if last:
                    seen["tail", " ".join(ws[-2:]), 0] += 1
            if not seen:
                return None
            kinds, items, ended = zip(*seen)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(items), pa.array(ended, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["kind", "item", "ended", "n"])

        return run

    return by_batch(answers.select("answer_text").distinct(), make, STATS).groupBy("kind", "item").agg(
        F.sum(F.when(F.col("ended") == 1, F.col("n")).otherwise(0)).alias("ended"), F.sum(F.when(F.col("ended") == 0, F.col("n")).otherwise(0)).alias("open")
    )


def pairs_of(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answer_id, query_text, answer_text of every answer with a question, once per key."""
    a = answers.select("answer_id", "query_id", "answer_text").filter("answer_id is not null and query_id is not null")
    a = a.groupBy("answer_id").agg(F.max(F.struct("query_id", "answer_text")).alias("r")).select("answer_id", "r.*")
    q = questions.select("query_id", "query_text").filter("query_id is not null").groupBy("query_id").agg(F.max("query_text").alias("query_text"))
    return a.join(q, "query_id").select("answer_id", "query_text", "answer_text")


def defects(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answer_id, defect of every defective answer."""
    stage = Stage(answers.sparkSession, "pairs")
    rows = stage.save(pairs_of(answers, questions), "pairs")
    judged = stage.save(_judge(rows), "judged")
    stats = stage.save(_statistics(rows), "statistics")
    opens = stats.filter("kind = 'open'").select(F.col("item").alias("opening"), "ended", "open")
    words = stats.filter("kind = 'word' and ended > 0").select("item")
    known = words.select(F.col("item").alias("last"), F.lit(True).alias("known"))
    lengths = F.sequence(F.lit(1), F.length("item") - 1)
    begun = words.filter(F.length("item") > 1).select(F.explode(F.transform(lengths, lambda i: F.substring("item", F.lit(1), i))).alias("last"))
    begun = begun.distinct().withColumn("begun", F.lit(True))
    # words that end several unfinished texts and stand nowhere else end a phrase
    texts = stats.filter("kind = 'texts'").first()
    least = max(1, int(CLOSING * texts.ended)) if texts else 1
    closing = stats.filter(f"kind = 'tail' and ended = 0 and open > {least}").select(F.col("item").alias("tail"), F.lit(True).alias("closing"))
    out = judged.join(closing, "tail", "left").join(opens, "opening", "left").join(known, "last", "left").join(begun, "last", "left")
    cut_word = F.col("begun") & F.col("known").isNull() & F.col("last").rlike(r"^\p{L}+$") & (F.col("words") > 2)
    sentence = F.col("opening").isNotNull() & F.col("closing").isNull() & (F.col("words") >= 5) & (F.coalesce("ended", F.lit(0)) > 2 * F.coalesce("open", F.lit(0)))
    defect = F.coalesce("defect", F.when(F.coalesce(cut_word, F.lit(False)) | sentence, F.lit("truncated")))
    return out.select("answer_id", defect.alias("defect")).filter("defect is not null")
