"""Problem 8: template residue, filler, error pages and notices that scripts are needed.

Trusted labels come from rules on the whole text: unfilled slots by their syntax, the rest by how much of a document's
own content, once menus and markup are off, consists of residue. Near-duplicates are found with SimHash tables and, as
those miss most pairs near the least similarity, with a prefix filter over shingles that holds every pair; both are
verified by the similarity of their five-word shingles, and joined into components; a document that no rule knows takes
the label of a component in which residue makes up the content. Slots are not passed on: the
near-duplicate of a text with a slot is often the same text with the slot filled.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.canonical import visible
from millrace.llm.components import connected_components
from millrace.session import spread, written

#: Words of a shingle, and the least share of shingles that near-duplicates have in common.
SHINGLE, SIMILAR = 5, 0.8
#: A fingerprint of 64 bits in 6 blocks; a table keys on 3 of them, 31 to 33 bits, so that chance meetings stay fewer than
#: nodes up to billions of them. Fingerprints up to 3 bits apart always meet; farther pairs come from the prefix filter.
BLOCKS, KEYED, HAMMING = 6, 3, 10
#: Counters of the sketch of shingle frequencies, and of a slice of it.
COUNTERS, SLICE = 1 << 22, 1 << 16
#: Share of a document's content that must be residue.
SHARE = 0.6

_ID = r"[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*"
_SLOTS = re.compile("|".join([
    rf"\{{\{{\s*{_ID}(?:\s*\|[^{{}}]{{0,40}})?\s*\}}\}}", rf"\{{%\s*{_ID}(?: [\w ]{{0,30}})?\s*%\}}", rf"\$\{{\s*{_ID}\s*\}}", r"(?<![\w$])\$[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*\$(?![\w$])",
    rf"<<\s*{_ID}\s*>>", rf"<%=?\s*{_ID}\s*%>", r"\[\s*(?:insert|enter|add|fill in)\s+[\w ]{2,40}\]", r"\[\s*[\w ]{2,40} (?:goes|comes) here\s*\]", r"\[\s*your [\w ]{2,40}\]",
    rf"(?<![\w#&])#{_ID}#(?!\w)", r"%\([A-Za-z_]\w*\)[sd]", r"(?<![\w%])%[sd](?![\w%])", r"(?<![\w{$\\^_])\{(?:\d{1,2}|[A-Za-z][a-z0-9]+(?:_[A-Za-z0-9]+)*|[A-Z0-9_]{3,})\}(?!\})", r"(?<![\w_])__[A-Z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?![\w_])", r"(?<![\w_])__[a-z0-9]+(?:_[a-z0-9]+)+__(?![\w_])",
]), re.I)
_SLOT_SIGNS = re.compile(r"[{<%#$\[]|__")
_ANGLE = re.compile(r"<([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*)>")
#: Tags that may stand without a closing one.
_OPEN_TAGS = frozenset("br hr p li ul ol td tr th img input meta link wbr col tbody thead option dt dd final_answer answer think tool_call tool_response".split())
_SPEAKS_OF = re.compile(r"\b(?:templates?|placeholders?|slots?|braces|brackets|variables?|syntax|macros?|format string)\b|vorlage|platzhalter|plantilla|modèle|шаблон|テンプレート", re.I)
_QUOTED = re.compile(r"[\"“”«»„`「』'‘’].{0,160}$", re.S)

# Words of menus.
_MENU = frozenset("home|menu|search|log in|login|log out|sign in|sign up|about|about us|contact|help|imprint|terms|privacy|cookies|share|print|language|sitemap|archive|top of page|top|back|next|previous|faq|news|settings|skip to content".split("|"))
_ABOUT = re.compile(r"about (?:this|the|our) \w+$")
_MENU_CUT = re.compile(r"\s*(?:[|»›·•/]|\s-\s|—|–|>|\n)\s*")

# Units (lines or sentences) of error pages, in the languages of the data and the usual ones of the web.
_STATUS = r"(?:bad request|unauthori[sz]ed|forbidden|not found|gone|too many requests|internal server error|internal error|bad gateway|service unavailable|gateway time-?out|request time-?out|method not allowed|payment required|conflict|not implemented|access denied|page not found|server error|service temporarily unavailable|rate limit(?:ed)?)"
_ERROR = re.compile(r"^(?:" + "|".join([
    rf"(?:https? ?)?(?:error |status |code |http )*[45]\d\d[ :.\-–—]+(?:error[ :]*)?{_STATUS}(?:[ .:\-].{{0,12}})?", r"(?:https?[ :]+|error[ :]+|status[ :]+|code[ :]+)+[45]\d\d(?:[ .:\-].{0,12})?", rf"(?:error[ :\-]*)?{_STATUS}", r"(?:an? )?(?:unexpected |internal |unknown |server |fatal )*error(?: occurred| has occurred)?.{0,25}",
    r"please (?:try|sign in|log in|reload|refresh|come back|contact|check|wait).{0,60}", r"(?:try|sign in|log in) again.{0,40}", r"the server (?:could not|cannot|encountered|is|was|returned|did not).{0,80}", r"the (?:page|resource|document|requested|passage|url|address)(?: \w+){0,4} (?:is not here|was not found|could not be found|cannot be found|not found|does not exist|no longer exists|has moved|is gone|is missing|is unavailable).{0,50}",
    r"/[\w/\-.]+", r"(?:reference|request id|incident|ray(?: id)?|trace|error id|code)[ :#]+[\w\-]{3,40}", r"(?:oops|whoops|uh[- ]oh|sorry)[!,. ]*(?:something went wrong|we can['’]?t find that page|that page.{0,40}|there was.{0,40}|an error.{0,40})?.{0,20}", r"something went wrong.{0,40}", r"well,? this is awkward",
    r"(?:sorry,? )?(?:we|i) (?:can['’]?t|cannot|could not|couldn['’]t) find (?:that|the|this|your) (?:page|passage|document).{0,30}", r"this (?:page|site|service|passage) (?:has moved|is down|is unavailable|is temporarily unavailable|no longer exists|does not exist|isn['’]t available|is not available|cannot be displayed|can['’]t be reached|is currently).{0,60}",
    r"(?:check|verify) the (?:address|url|spelling).{0,40}", r"you (?:do not|don['’]t) have (?:permission|access|the rights?).{0,50}", r"you are not (?:authori[sz]ed|allowed|permitted).{0,50}", r"slow down.{0,40}", r"your session (?:has )?(?:expired|timed out|ended).{0,40}", r"contact the (?:administrator|site owner|webmaster|support).{0,40}",
    r"(?:scheduled |planned |down for )?maintenance.{0,40}", r"(?:expected|estimated|planned) (?:end|start|return|downtime|duration|completion)[ :]+.{0,20}", r"go back to the (?:start|home|previous|front).{0,60}", r"if this (?:keeps happening|problem persists|persists|continues|error).{0,60}", r"(?:write|report) (?:this )?to the (?:site owner|administrator|webmaster).{0,20}", r"(?:request|connection|upstream|read|the operation|the request) (?:has )?timed? ?out.{0,30}", r"access (?:to this (?:page|site) )?(?:is |was |has been )?denied.{0,30}", r"(?:too many|rate limit).{0,40}requests?.{0,30}", r"(?:an )?error (?:establishing|connecting|while|loading|reading|retrieving|processing|fetching|opening).{0,80}", r"(?:warning|fatal error|notice|error)[: ]+(?:\w+ ){0,6}(?:failed|error|invalid|undefined|denied|refused|not found|timed out|exceeded).{0,60}", r"(?:could not|cannot|can['’]?t|failed to|unable to) (?:connect|load|open|reach|fetch|read|resolve|retrieve|establish|contact|display|process).{0,70}", r"(?:fatal|warning|notice|critical|panic)[: ]+.{0,80}(?:code|errno|line|failed|cannot|could not|unable).{0,40}", r"(?:query|connection|request|lookup|search) (?:failed|refused|reset|aborted|closed).{0,50}", r"we (?:are|will be|['’]ll be) (?:making|working|back|doing|upgrading|improving|currently|temporarily|down|performing).{0,70}", r"(?:and )?(?:will be |we['’]ll be )?back (?:shortly|soon|online).{0,30}",
    r"erreur (?:interne|du serveur|\d{3}|inconnue|de connexion).{0,40}", r"page (?:non trouvée|introuvable).{0,40}", r"(?:le )?service (?:est )?(?:temporairement )?indisponible.{0,40}", r"accès (?:refusé|interdit).{0,30}", r"veuillez réessayer.{0,40}", r"vérifiez l['’]adresse.{0,20}", r"(?:votre|la) session (?:a|est) expirée?.{0,20}", r"une erreur (?:est survenue|s['’]est produite|interne).{0,40}",
    r"página no (?:encontrada|disponible).{0,30}", r"compruebe la dirección.{0,20}", r"error (?:interno|del servidor|de conexión).{0,40}", r"servicio (?:temporalmente )?no disponible.{0,30}", r"acceso denegado.{0,30}", r"inténte?lo (?:de nuevo|más tarde).{0,30}", r"(?:por favor,? )?(?:inténtelo|vuelva a intentarlo).{0,40}", r"(?:su|la) sesión ha (?:caducado|expirado).{0,20}", r"se ha producido un error.{0,30}",
    r"(?:interner |unbekannter )?(?:server)?fehler(?: \d{3})?.{0,30}", r"seite (?:wurde )?nicht gefunden.{0,30}", r"die (?:gesuchte|angeforderte|gewünschte) (?:adresse|seite|datei).{0,50}", r"(?:die |diese )?(?:gewünschte |angeforderte )?seite (?:wurde|konnte|ist|existiert).{0,50}", r"bitte (?:versuchen|prüfen|überprüfen|melden).{0,50}", r"dienst (?:ist )?(?:vorübergehend |derzeit |zurzeit )?nicht (?:verfügbar|erreichbar).{0,30}", r"zugriff verweigert.{0,30}", r"(?:ihre )?sitzung ist abgelaufen.{0,20}", r"wartungsarbeiten.{0,30}",
    r"сервис (?:временно )?недоступен.{0,30}", r"страница не (?:найдена|существует).{0,30}", r"(?:внутренняя )?ошибка(?: сервера| \d{3})?.{0,30}", r"доступ (?:запрещ[её]н|закрыт).{0,30}", r"(?:пожалуйста,? )?(?:попробуйте|повторите|проверьте).{0,50}", r"сессия истекла.{0,20}", r"сервер (?:не отвечает|недоступен).{0,30}", r"произошла ошибка.{0,30}",
    r"pagina non (?:trovata|disponibile|esiste).{0,30}", r"errore (?:interno|del server|di connessione|\d{3}).{0,40}", r"servizio (?:temporaneamente )?non disponibile.{0,30}", r"accesso negato.{0,30}", r"si è verificato un errore.{0,30}", r"(?:si prega di )?riprova(?:re)?\b.{0,40}", r"la pagina (?:richiesta|cercata).{0,50}",
    r"página não (?:encontrada|disponível).{0,30}", r"erro (?:interno|do servidor|de conexão|\d{3}).{0,40}", r"serviço (?:temporariamente )?indisponível.{0,30}", r"acesso negado.{0,30}", r"ocorreu um erro.{0,30}", r"(?:por favor,? )?tente novamente.{0,40}",
    r"pagina niet gevonden.{0,30}", r"(?:interne )?serverfout.{0,30}", r"er is een fout opgetreden.{0,30}", r"probeer het (?:later )?opnieuw.{0,30}", r"toegang geweigerd.{0,30}",
    r"strona nie (?:została znaleziona|istnieje).{0,30}", r"nie znaleziono (?:żądanej )?strony.{0,30}", r"(?:wewnętrzny )?błąd (?:serwera|wewnętrzny|\d{3}).{0,30}", r"wystąpił błąd.{0,30}", r"odmowa dostępu.{0,30}", r"usługa (?:jest )?(?:tymczasowo )?niedostępna.{0,30}", r"spróbuj ponownie.{0,30}",
    r".{0,12}(?:页面|网页|頁面|網頁).{0,8}(?:不存在|未找到|找不到|无法访问|無法訪問).{0,15}", r".{0,12}(?:找不到|未找到)(?:该|该个|此|这个|所请求的)?(?:页面|网页|頁面|網頁).{0,15}", r".{0,12}(?:服务器|伺服器|内部|內部|系统|系統).{0,6}(?:错误|錯誤|繁忙).{0,15}", r".{0,12}(?:拒绝访问|拒絕存取|请稍后再试|請稍後再試|服务不可用|服務暫時無法使用).{0,15}",
    r".{0,15}페이지를? ?(?:찾을 수 없|표시할 수 없).{0,15}", r".{0,15}(?:서버|내부) ?오류.{0,15}", r".{0,15}(?:접근이? 거부|액세스가? 거부|다시 시도|서비스를 (?:사용|이용)할 수 없|일시적으로 이용).{0,15}",
    r".{0,20}ページ(?:が|は)(?:見つかりません|存在しません|表示できません).{0,25}", r".{0,20}(?:エラー|サーバー).{0,25}", r".{0,15}アクセス(?:が拒否|できません|権限).{0,20}", r".{0,15}(?:しばらく|後ほど|後で|もう一度).{0,25}", r".{0,15}(?:メンテナンス|利用できません|ご利用いただけません|一時的に).{0,25}", r".{0,10}(?:アドレス|url)をご?確認.{0,15}",
]) + r")$", re.I)
#: A status code alone may as well be a number; it counts only beside other residue.
_CODE = re.compile(r"^[45]\d\d$")
_JS = r"(?:javascript|java script|scripts?|scripting|active content|cookies and javascript)"
_SCRIPT = re.compile(r"^(?:noscript[: ]*)?(?:" + "|".join([
    rf"(?:please |you must |you need to |to continue,? )*(?:enable|turn on|activate|allow|switch on) {_JS}.{{0,70}}", rf"{_JS} (?:is|are|must be|has to be|needs? to be|seems to be|appears to be) (?:disabled|switched off|turned off|off|blocked|enabled|required to|needed|not enabled|not available|not running)\b.{{0,70}}", rf"{_JS} (?:is|are) required(?: to (?:view|continue|use|run|see|load|read|open|show|display).{{0,50}}| for (?:this|the).{{0,40}})?",
    rf"(?:your|this|the) (?:browser|page|reader|site|app|application|website)(?: \w+){{0,3}} (?:does not support|doesn['’]t support|has disabled|needs?|requires?|works|relies on|must have|is blocking|blocks)(?: \w+){{0,3}} {_JS}.{{0,80}}", rf"this (?:reader|page|site|app) works (?:with|only with) {_JS}.{{0,60}}", rf"(?:we|you) (?:could not|cannot|can['’]t|need to|must|have to) (?:\w+ ){{0,4}}(?:because )?(?:\w+ ){{0,3}}{_JS}.{{0,80}}", rf"(?:we )?could not load the app.{{0,90}}",
    r"turn it on in (?:the|your) (?:settings|browser|options).{0,40}", r"(?:and )?reload the page", r"loading(?: the \w+)?", r"(?:verifying|checking|securing) (?:the|your|that|if|you).{0,60}", r"just a moment", r"one more step.{0,60}", r"one moment.{0,20}", r"(?:please )?(?:confirm|verify|prove|show) (?:that )?you are (?:a |not a |an? )?(?:human|robot|person).{0,30}", r"(?:please )?(?:complete|solve) the (?:captcha|security check|challenge).{0,40}", r"(?:ddos protection|performance (?:&|and) security) by.{0,30}", r"(?:please )?(?:enable|allow|accept) cookies.{0,50}", r"(?:this|it) (?:may|should|will) (?:only )?take a few seconds.{0,20}", r"you will be redirected.{0,40}", r"(?:in order )?to (?:continue|go on|proceed|(?:view|see|read|use|open|load|show) (?:the|this|it|more)).{0,30}",
    r"(?:active|habilite|active usted|debe activar|necesita activar) (?:el )?javascript.{0,60}", r"javascript (?:está|es|esté|debe).{0,60}", r"(?:veuillez )?(?:activer|activez|autorisez) (?:le |les )?(?:javascript|scripts).{0,60}", r"javascript (?:est|doit|n['’]est).{0,60}", r"(?:bitte )?(?:aktivieren|schalten|erlauben) sie (?:bitte )?(?:javascript|skripte).{0,60}", r"(?:bitte )?javascript (?:ist|muss|aktivieren|einschalten|zulassen|wird).{0,60}", r"(?:diese seite|dieser leser|ihr browser|diese anwendung) (?:benötigt|braucht|unterstützt|erfordert).{0,20}(?:javascript|skripte).{0,50}", r"(?:esta página|este sitio|su navegador|este lector) (?:necesita|requiere|no admite|no es compatible).{0,20}(?:javascript|scripts).{0,50}", r"(?:cette page|ce site|votre navigateur|ce lecteur) (?:nécessite|requiert|a besoin|ne prend|n['’]accepte).{0,25}(?:javascript|scripts).{0,50}",
    r"(?:per favore,? )?(?:abilita|attiva|abilitare|attivare) (?:il )?javascript.{0,60}", r"(?:questa pagina|questo sito|il (?:tuo |suo )?browser) (?:richiede|necessita|non supporta).{0,20}(?:javascript|script).{0,50}", r"(?:por favor,? )?(?:ative|habilite|ativar|habilitar) (?:o )?javascript.{0,60}", r"(?:esta página|este site|o? ?seu navegador) (?:requer|precisa|necessita|não suporta).{0,20}(?:javascript|scripts).{0,50}",
    r"(?:schakel|zet) javascript (?:in|aan).{0,50}", r"(?:proszę )?(?:włącz|włączyć|aktywuj) (?:obsługę )?javascript.{0,60}", r".{0,15}(?:启用|啟用|开启|開啟|打开|允许|支持|禁用).{0,6}(?:javascript|脚本|腳本).{0,30}", r".{0,20}(?:javascript|脚本|腳本).{0,8}(?:禁用|停用|关闭|未启用).{0,20}", r".{0,25}(?:javascript|자바스크립트|스크립트).{0,8}(?:활성화|사용|켜|허용|필요|꺼져).{0,30}",
    r"(?:пожалуйста,? )?(?:включите|разрешите|активируйте) (?:javascript|скрипты|сценарии).{0,60}", r"(?:javascript|скрипты) (?:отключ|выключ|должн|необходим|требу).{0,60}", r".{0,40}(?:нужен|нужны|требуется|требуются) (?:javascript|скрипты).{0,40}", r".{0,30}(?:javascript|スクリプト).{0,12}(?:有効|オン|無効|オフ|必要|許可).{0,30}", r".{0,15}読み込み中.{0,10}",
]) + r")$", re.I)
_STUB = re.compile(r"^(?:" + "|".join([
    r"todo\b.{0,60}", r"(?:tbd|tba|tbc|n/?a|wip|xxx+|fixme|asdf\w*|foo|bar|foo bar.{0,10}|test|test test.{0,30}|dummy|placeholder|null|none|undefined|nan)", r"to be (?:added|done|written|defined|announced|filled(?: in)?|completed|continued|translated|supplied)(?: (?:later|soon))?", r"\(?(?:content|text|more|page|passage|article|details?|description) (?:is )?(?:coming soon|follows(?: later)?|will follow(?: later)?|to follow|goes here|to come|pending|missing|here)\)?", r"coming soon", r"under construction",
    r"[-–—=*_.#~ …]+", r"#?\d{1,4}", r"(?:new|untitled|sample|example|dummy|empty|blank) (?:passage|page|document|entry|text|record|title|article|item|section|paragraph)(?: #?\d+)?", r"(?:sample|dummy|example|placeholder|filler|test) (?:passage|content|entry|text|paragraph|data|record)\b.{0,70}", r"nothing to (?:read|see) here.{0,20}", r"click (?:here )?to (?:edit|add|enter|change).{0,30}", r"add (?:a|an|your|some) (?:caption|title|subtitle|text|image|description|heading|summary).{0,20}", r"(?:sub)?title", r"author(?:['’]s)?(?: name)?", r"name of (?:the )?(?:town|author|place|person|country|city|founder|entity).{0,60}", r"date(?: of \w+)?", r"(?:first|second|third|last|next|another|main) paragraph.{0,40}", r"(?:your|the) (?:text|title|content|name|passage|description) here", r"(?:type|write|enter|paste|put|insert) (?:your |the |some )?(?:text|content|title|passage|name|description)(?: here)?.{0,15}", r"(?:country|population|founder|region|heading|caption|body|summary|abstract|keywords|label|value|field)", r"replace (?:it|this|me|the text|this text|this line).{0,50}", r"this (?:is )?(?:a |an |some )?(?:sample|dummy|placeholder|filler|example|test|blank)(?: \w+)?(?: (?:text|entry|paragraph|passage|page))?.{0,50}", r"(?:text|paragraph|passage|entry) (?:to be )?(?:replaced|filled in).{0,30}",
    r"(?:body text|text|body|content) (?:of|for|under) (?:the )?(?:heading|section|title|chapter|paragraph|part|page).{0,20}", r"(?:heading|section|chapter|part|paragraph|item|column|bullet|line|point|option)(?: (?:no\.? ?)?#?\d+| [a-z])", r"(?:aquí|acá) (?:irá|va|debe ir|iría|aparecerá).{0,50}", r"(?:pendiente|por) (?:de )?(?:redactar|escribir|completar|traducir|añadir|definir).{0,30}", r"(?:заготовка|заглушка|шаблон)\b.{0,40}", r"(?:заменить|дополнить|дописать|заполнить) (?:позже|потом|текст).{0,30}", r"(?:hier|an dieser stelle) (?:steht|kommt|folgt|erscheint|wird) (?:später |bald |noch )?(?:der|ein|das|die)?.{0,50}", r"(?:wird|bitte) (?:später|noch|bald) (?:ersetzt|ergänzt|ausgefüllt|eingefügt|ersetzen|ergänzen).{0,30}", r"(?:später|noch) (?:zu )?(?:ersetzen|ergänzen|ausfüllen|schreiben).{0,30}", r"(?:ici|là) (?:viendra|ira|sera|apparaîtra|se trouvera).{0,50}", r"à (?:remplacer|compléter|rédiger|définir|écrire|traduire).{0,30}",
    r"(?:texte|contenu|paragraphe|page|suite|article|titre) (?:à venir|provisoire|à remplacer|de remplissage|à compléter|bientôt|d['’]exemple|en construction).{0,40}", r"(?:texto|contenido|párrafo|página|artículo|título) (?:pendiente|provisional|de relleno|de ejemplo|por añadir|próximamente|de prueba|en construcción).{0,40}", r"(?:text|inhalt|absatz|seite|titel|artikel|platzhalter(?:text)?|beispieltext|blindtext|mustertext)(?: (?:folgt|kommt|wird|hier|ersetzen|einfügen|in kürze)).{0,40}", r"(?:platzhalter(?:text|absatz)?|blindtext|beispieltext|mustertext|fülltext)\b.{0,40}", r"(?:vorläufiger|provisorischer) (?:absatz|text|titel).{0,40}", r"(?:noch )?(?:nicht ausgefüllt|zu ergänzen|wird ergänzt|wird nachgereicht).{0,30}", r"(?:texto|párrafo|contenido) (?:\w+ ){0,3}(?:sustituir|reemplazar|completar).{0,30}", r"(?:текст|содержание|абзац|страница|заголовок|статья|раздел)(?: \w+){0,3} (?:будет|появится|добав\w+|заглушк\w+|замен\w+|скоро|позже).{0,40}", r"(?:временный|пробный|примерный|тестовый) (?:текст|абзац).{0,40}", r"(?:здесь|тут) (?:будет|появится|должен).{0,40}", r".{0,15}(?:準備中|近日公開|仮の(?:文章|段落|テキスト)|ダミー|サンプルテキスト|ここに.{0,8}(?:入力|文章|本文)|後で追加|追って|差し替え|工事中|未定).{0,25}",
]) + r")$", re.I)
# Words of pseudo-Latin filler.
_LOREM = frozenset("""lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam
quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat
non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum vestib ornare felis adipo facilis facilisis quentum vexa cras donec ultri ultrices porta pellentesque mauris
vivamus curabitur praesent nunc quam justo lacus libero sapien turpis viverra""".split())
_TRACE = re.compile(r"^\s*(?:traceback \(most recent call last\):|exception in thread|(?:[\w.]+(?:error|exception)): .{0,200}\n\s+at )", re.I)
# The fields of a JSON error reply; one of the first, or a status of 400 and more, makes it one.
_FAULTS, _STATUS_FIELDS = frozenset("error errors fault exception".split()), frozenset("status code statuscode status_code".split())
_REPLY_FIELDS = _FAULTS | _STATUS_FIELDS | frozenset("message msg detail details description reason type title path instance timestamp time request_id requestid trace_id traceid id ok success retry_after help hint documentation_url".split())
_SEARCH_JSON = re.compile(r"^\s*\{\s*[\"']query[\"']\s*:[\s\S]*[\"'](?:num_results|results)[\"']\s*:")
_TAGS = re.compile(r"</?[a-z!][^<>]{0,200}>", re.I)
_BLOCK = re.compile(r"\n\s*\n")
_UNIT = re.compile(r"\n+|(?<=[.!?。！？])\s*(?=[\w(\[¿¡#])(?<!\d\.)|(?<=[。！？])|\s+\|\s+|\s+»\s+")


def json_error(text: str) -> bool:
    """Whether the text is a JSON object with nothing but the fields of an error reply, whatever its length."""
    if text.lstrip()[:1] != "{" or text.rstrip()[-1:] != "}":
        return False
    try:
        obj = json.loads(text, strict=False)
    except (ValueError, RecursionError):
        return False
    keys = {str(k).casefold(): v for k, v in obj.items()} if isinstance(obj, dict) else {}
    if not keys or not keys.keys() <= _REPLY_FIELDS:
        return False
    codes = [str(v) for k, v in keys.items() if k in _STATUS_FIELDS]
    return bool(_FAULTS & keys.keys()) or any(re.fullmatch(r"[45]\d\d", c) for c in codes) or (codes == ["error"])


def _values(obj: object) -> Iterator[str]:
    todo = [obj]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, (dict, list)):
            todo.extend(x.values() if isinstance(x, dict) else x)


def slot_in_reply(text: str) -> bool:
    """Whether a value of a search reply (JSON) holds an unfilled slot; its own braces and brackets are none."""
    if not _SLOT_SIGNS.search(text):
        return False
    try:
        return any(slot(x) for x in _values(json.loads(text, strict=False)))
    except (ValueError, RecursionError):
        return False


def units(text: str) -> list[str]:
    return [u for u in (x.strip() for x in _UNIT.split(text)) if u]


def slot(text: str) -> bool:
    """Whether a template slot stands where a value belongs; a slot that a sentence on templates quotes does not count."""
    if not _SLOT_SIGNS.search(text):
        return False
    closed = {m.lower() for m in re.findall(r"</\s*([A-Za-z]\w*)", text)}
    found = [m.span() for m in _SLOTS.finditer(text)]
    for m in _ANGLE.finditer(text):
        name = m.group(1).lower()
        if name not in closed and name not in _OPEN_TAGS and len(name) > 2:
            found.append(m.span())
    for a, b in found:
        start = max(text.rfind("\n", 0, a), *(text.rfind(x, 0, a) for x in (". ", "! ", "。"))) + 1
        ends = [e for e in (text.find("\n", b), text.find(". ", b), text.find("。", b)) if e >= 0]
        sentence = text[start : min(ends, default=len(text))]
        if not (_SPEAKS_OF.search(sentence.replace(text[a:b], " ")) and _QUOTED.search(text[start:a])):
            return True
    return False


def _menu(part: str) -> bool:
    """Whether a unit or a block of lines is a menu: short entries without a full stop, all or a third of them usual ones."""
    entries = [p for x in _MENU_CUT.split(part) if (p := x.strip(" .:").casefold())]
    known = sum(p in _MENU or bool(_ABOUT.match(p)) for p in entries)
    short = all(len(p.split()) < 4 and not re.search(r"[.!?。\d]", p) for p in entries)
    return known == len(entries) or (short and len(entries) > 1 and known * 3 >= len(entries))


def _lorem(unit: str) -> bool:
    w = re.findall(r"[^\W\d_]+", unit)
    return len(w) >= 3 and sum(x in _LOREM for x in w) >= 0.6 * len(w)


def whole_label(text: str) -> str | None:
    """error, script or filler if that is what the content consists of; None for real content."""
    if _SEARCH_JSON.match(text):
        return None
    v = visible(text)
    if json_error(v):
        return "error"
    bare = _TAGS.sub("\n", v)
    body = [u for block in _BLOCK.split(bare) if not _menu(block) for u in units(block) if not _menu(u)]
    if not body:
        return None
    content = "\n".join(body)
    if _TRACE.match(content):
        return "error"
    if json_error(content):
        return "error"
    w = re.findall(r"\w+", content)
    if len(w) >= 6 and len(set(w)) <= max(1, len(w) // 6):
        return "filler"
    size, other, residue = sum(max(1, len(u)) for u in body), 0, {"error": 0, "script": 0, "filler": 0, "neutral": 0}
    for u in sorted(body, key=len, reverse=True):
        if other > (1 - SHARE) * size:
            return None  # what is left cannot bring residue to its share
        k = u.strip(" .!?:,;…。！？\t-–—*#()[]{}\"'“”»«>|")
        n = max(1, len(u))
        kind = "neutral" if not k or _CODE.match(k) else "filler" if _lorem(u) else "script" if _SCRIPT.match(k) else "error" if _ERROR.match(k) else "filler" if _STUB.match(k) or _STUB.match(u) else None
        if kind is None and len(k) > 3:
            # several short stubs in one line
            parts = [p.strip(" .()") for p in re.split(r"\s+[-–|/]\s+|[.!?]\s+", k)]
            if len(parts) > 1 and all(_STUB.match(p) or _ERROR.match(p) or _SCRIPT.match(p) for p in parts if p):
                kind = "filler" if _STUB.match(parts[0]) else "script" if _SCRIPT.match(parts[0]) else "error"
        if kind:
            residue[kind] += n
        else:
            other += n
    strong = {k: n for k, n in residue.items() if k != "neutral"}
    label = max(strong, key=strong.get)
    if strong[label] == 0:
        # nothing but dashes, dots and the like stands where content should be
        return "filler" if not w and re.search(r"[-–—_=~*.…]\s*[-–—_=~*.…]\s*[-–—_=~*.…]", content) else None
    if sum(residue.values()) < SHARE * size:
        return None
    if label == "filler" and re.fullmatch(r"[#\d\s.,:;\-–—%/()]*(?:km|m|kg)?[.\s]*", content):
        return None  # a bare number or sign is a terse answer
    return label


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+|\d+", re.sub(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", "0", visible(text)))


@functools.lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(("0" if word[0].isdigit() else word).encode("utf-8", "surrogatepass"))


def shingles_of(toks: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words (numbers masked); a shorter text is one run."""
    if not toks:
        return np.empty(0, np.uint64)
    h = np.fromiter((_hash(t) for t in toks), np.uint64, len(toks))
    width = min(SHINGLE, len(h))
    run = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        run = (run ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    return np.unique(run)


def simhash(h: np.ndarray) -> int:
    if len(h) == 0:
        return 0
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _node(toks: list[str]) -> bytes:
    return hashlib.blake2b(" ".join("0" if x[0].isdigit() else x for x in toks).encode("utf-8", "surrogatepass"), digest_size=12).digest()


def _fingerprints(docs: DataFrame) -> DataFrame:
    """id, label, node (96-bit key of the words) and simhash of every text with words in it.

    Shingles are made anew where they are needed; only rows without id carry their text along.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, known in zip(b["_id"], b["_text"], b["_known"]):
                if not t.strip():
                    continue
                toks = words_of(t)
                sh = shingles_of(toks)
                label = whole_label(t)
                open_ = label is None and (slot_in_reply(t) if _SEARCH_JSON.match(t) else slot(t))
                rows.append((i, "slot" if open_ else label, _node(toks), simhash(sh), None if known else t))
            yield pd.DataFrame(rows, columns=["_id", "label", "node", "hash", "text"])

    schema = docs.select("_id").schema.add("label", "string").add("node", "binary").add("hash", "long").add("text", "string")
    return docs.withColumn("_known", F.col("_id").isNotNull()).mapInPandas(part, schema)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and _text of every node (node, rep: the id of a row that has the text, text where there is none).

    An id that several rows have brings all their texts; ``_runs`` leaves out those that are not the node's.
    """
    made = docs.join(nodes.filter("rep is not null").select(F.col("rep").alias("_id"), "node"), "_id").select("node", "_text")
    return made.unionAll(nodes.filter("rep is null").select("node", F.col("text").alias("_text")))


def _runs(b: pd.DataFrame) -> Iterator[tuple[bytes, np.ndarray]]:
    for n, t in zip(b["node"], b["_text"]):
        if _node(toks := words_of(t)) == bytes(n):
            yield n, shingles_of(toks)


def _shingled(texts: DataFrame) -> DataFrame:
    """node and shingles of texts (node, _text)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(n, sh.astype(np.int64)) for n, sh in _runs(b)], columns=["node", "shingles"])

    schema = texts.select("node").schema.add("shingles", T.ArrayType(T.LongType()))
    return texts.mapInPandas(part, schema).groupBy("node").agg(F.first("shingles").alias("shingles"))


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each and in the same order: up to 127 as they are, above in steps of a fifth of a doubling."""
    return np.where(counts < 128, counts, 128 + np.floor(5 * np.log2(np.maximum(counts, 128) / 128))).astype(np.uint8)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """Levels of the counts of the shingles' hashes, each in one of COUNTERS; a shingle is in no more texts than its counter says.

    Tasks count for themselves and send the slices that are not empty; those are added up where their number sends them.
    The driver gets one slice at a time and keeps a byte a counter.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            for _, sh in _runs(b):
                np.add.at(c, (sh % np.uint64(COUNTERS)).astype(np.int64), 1)
        for i, part in enumerate(c.reshape(-1, SLICE)):
            if part.any():
                yield pd.DataFrame({"slice": [i], "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b["slice"], b["counts"]):
                part = np.frombuffer(zlib.decompress(raw), np.uint32)
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            yield pd.DataFrame({"slice": [i], "counts": [zlib.compress(part.tobytes(), 1)]})

    kind = "slice int, counts binary"
    out = np.zeros(COUNTERS, np.uint8)
    for r in texts.mapInPandas(count, kind).repartition("slice").mapInPandas(add, kind).toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = _levels(np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32))
    return out


def prefix_pairs(texts: DataFrame) -> DataFrame:
    """(a, b) of different nodes of texts (node, _text): every pair whose shingles have SIMILAR in common, and others.

    Shingles are put in one order for all texts, the rare first. Of n shingles, those beyond n - SIMILAR n + 1 cannot be
    the first that two similar texts have in common, so such texts meet in one of these. Shingles that only one text has
    need no key. A pair stays if a shingle that it meets in leaves room for enough common ones after it.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_frequencies(texts))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for b in batches:
            rows = []
            for node, sh in _runs(b):
                n, often = len(sh), c[(sh % np.uint64(COUNTERS)).astype(np.int64)]
                # The slack keeps rounding from shortening a prefix.
                first = np.lexsort((sh, often))[: n - math.ceil(SIMILAR * n - 1e-9) + 1]
                rows.extend((node, int(k), i, n) for i, (k, f) in enumerate(zip(sh[first].astype(np.int64), often[first])) if f > 1)
            yield pd.DataFrame(rows, columns=["node", "k", "at", "n"])

    schema = texts.select("node").schema.add("k", "long").add("at", "integer").add("n", "integer")
    keyed = written(texts.mapInPandas(part, schema), "prefixes")
    sent.destroy()  # else each query of a session leaves its counters with the driver and the executors
    a = keyed.withColumnsRenamed({"node": "a", "at": "ia", "n": "na"})
    b = keyed.withColumnsRenamed({"node": "b", "at": "ib", "n": "nb"})
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return a.join(b, "k").filter((F.col("a") < F.col("b")) & (room >= SIMILAR * (F.col("na") + F.col("nb") - room) - 1e-9)).select("a", "b").distinct()


def close_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of different nodes (node, hash) whose fingerprints are at most HAMMING bits apart and meet in a table.

    Each table keys on three of six blocks of the fingerprint. Copies of one text are one node before they come here, so a
    bucket holds different texts only, and pairs leave the join only if their Hamming distance passes.
    """
    width = [11, 11, 11, 11, 10, 10]
    at = list(itertools.accumulate([0, *width]))
    block = [F.shiftrightunsigned(F.col("hash"), at[i]).bitwiseAND((1 << width[i]) - 1) for i in range(BLOCKS)]
    tables = list(itertools.combinations(range(BLOCKS), KEYED))
    keys = F.array(*[F.lit(t) * (1 << 33) + block[i] * (1 << 22) + block[j] * (1 << 11) + block[k] for t, (i, j, k) in enumerate(tables)])
    keyed = nodes.select("node", "hash", F.explode(keys).alias("k"))
    a = keyed.select(F.col("node").alias("a"), F.col("hash").alias("ha"), "k")
    b = keyed.select(F.col("node").alias("b"), F.col("hash").alias("hb"), "k")
    far = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return a.join(b, "k").filter((F.col("a") < F.col("b")) & (far <= HAMMING)).select("a", "b").distinct()


def similar(pairs: DataFrame, shingled: DataFrame) -> DataFrame:
    """The pairs whose shingles (node, shingles) have at least SIMILAR in common."""
    s = shingled
    p = pairs.join(s.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(s.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return p.filter(both >= SIMILAR * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, component, n_links, by) of every document with a text; label is null for those to keep.

    label: slot, filler, error or script. by: ``rule`` or ``component``. component: the class of near-duplicates, named by
    its smallest node; n_links: links of the document's text to different texts in it.

    Null and blank texts are no case and are left out. Copies of one text share a node, so a text that holds a third of
    all rows is fingerprinted per row but paired once. Rows with a null id are kept as such. Empty tables give an empty
    result; other columns are ignored. Texts are read whole.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    prints = written(_fingerprints(spread(src)), "prints")
    trusted = F.max(F.when(F.col("label") != "slot", F.col("label"))).alias("trusted")
    nodes = written(prints.groupBy("node").agg(F.first("hash").alias("hash"), trusted, F.min("_id").alias("rep"), F.first("text", ignorenulls=True).alias("text")), "nodes")
    texts = written(_texts(src, nodes), "texts")
    pairs = written(close_pairs(nodes.select("node", "hash")).unionAll(prefix_pairs(texts)).distinct(), "pairs")
    wanted = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    links = written(similar(pairs, _shingled(wanted)), "links")
    comp = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    # A node without links is a component of its own: its rows may be labelled apart, as rules heed punctuation and lines.
    linked = nodes.select("node", "trusted").join(comp, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A component's label: the one most of its texts were given, if the trusted are at least half of them.
    votes = linked.groupBy("component").agg(F.mode("trusted").alias("passed"), F.count("trusted").alias("known"), F.count("*").alias("size"))
    passed = votes.filter("known > 0 and known * 2 >= size").select("component", "passed")
    linked = linked.select("node", "component", "n_links").join(passed, "component", "left")
    out = prints.select("_id", "label", "node").join(linked, "node", "left")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("label", "passed").alias("label"), F.lower(F.hex("component")).alias("component"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("label").isNotNull(), "rule").when(F.col("passed").isNotNull(), "component").alias("by"),
    )
