"""What error pages, filler and script notices are worded like: terms that speak for residue, never decide alone."""

from __future__ import annotations

import re

# Words of filler Latin.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    " augue ligula risus ipsum pretium justo lorem mollis quam tempus vero porta lectus felis ornare viverra ullam varius semper dapibus massa tortor morbi nostra vestibulum curabitur pellentesque vitae vel nec ac at eget donec praesent fusce integer maecenas nunc odio orci purus rhoncus sapien sodales tellus tincidunt turpis ultrices urna vivamus volutpat".split()
)
# Sample copy of site builders, in lower case.
SAMPLE = re.compile(
    r"sample copy|dummy text|placeholder|your content will appear|click here to edit|write something about your|describe your offer|add a short biography|replace with your own"
    r"|blindtext|mustertext|platzhalter|hier klicken, um diesen|beschreiben sie hier ihr|hier steht (?:ihr|dein)|faux texte|texte d[’']exemple|texte de remplacement|cliquez ici pour modifier|décrivez ici votre|votre contenu"
    r"|texto de relleno|texto de ejemplo|haz clic aquí para|describe aquí|tu contenido|見本の文章|本文が入ります|この段落を編集|ここをクリックして|ダミーテキスト|サンプルテキスト",
)
# Terms of error and host messages, in lower case; the reason phrases of HTTP are among them.
ERROR = re.compile(
    r"\b(?:not|n't|n’t|cannot|could not|nowhere to) be found\b|\bnot found\b|can[’']t (?:be found|find)|no longer (?:exists?|available|here)|(?:page|file|resource|url|site)\b[^.!?]{0,40}\b(?:moved|never existed|does ?n[o’']t exist|is missing)|page you are looking for"
    r"|(?:access|permission) (?:is |was )?denied|forbidden|unauthori[sz]ed|don[’']t have permission|not authori[sz]ed|method not allowed|not acceptable|bad (?:gateway|request)|gateway time-?out|request time-?out|service (?:is )?unavailable|temporarily (?:un(?:able|available)|down|offline)|internal (?:server )?error|server error|not implemented"
    r"|(?:web ?)?(?:server|site|website|host|origin) (?:is|was) (?:down|offline|unreachable|not responding)|connection (?:failed|refused|reset|timed out)|too many requests|rate limit|has been blocked|(?:account|domain|site|page|website|subscription|content|user|profile)\b[^.!?]{0,20} (?:has been|was|is|has) (?:suspended|disabled|removed|deleted|deactivated|expired|parked|blocked|closed)|session (?:has )?(?:ended|expired)|has expired"
    r"|no site has been set up|fatal error|uncaught|unhandled exception|traceback|stack trace|parse error|database (?:error|connection)|undefined (?:function|index|variable|method)|syntax error|exception in|null ?pointer|segmentation fault|under (?:construction|maintenance)|scheduled maintenance|not available\b|out of memory|something went wrong|an? (?:unexpected |unknown )?error (?:has )?occurred|timed out"
    r"|\b(?:http )?(?:error|status)(?: code)?:? ?\d{3,4}\b|\berror \d+|^\W*[45]\d\d\W+[a-z][a-z -]{2,30}$|^\W*[45]\d\d\W*$|\b410 gone\b|\"error\"|index of /|it works!|default (?:web )?page"
    r"|nicht gefunden|nicht verfügbar|nicht erreichbar|zugriff verweigert|keine berechtigung|interner (?:server)?fehler|wartung|wartungsarbeiten|vorübergehend|gesperrt|sitzung (?:ist )?abgelaufen|\bfehler \d+|erneut versuchen|fehler aufgetreten"
    r"|introuvable|n[’']existe (?:pas|plus)|accès (?:refusé|interdit)|pas le droit de voir|erreur interne|réessayez|indisponible|en maintenance|erreur \d+|session (?:a )?expiré|une erreur (?:est survenue|s[’']est produite)"
    r"|no se (?:ha )?encontr|no encontrad|no existe|acceso denegado|no tienes permiso|error interno|no está disponible|en mantenimiento|vuelve a intentarlo|sesión (?:ha )?caducad|ha ocurrido un error"
    r"|non (?:è stata )?trovat[ao]|accesso negato|non disponibile|não (?:foi )?encontrad[ao]|acesso negado|indisponível|niet gevonden|toegang geweigerd|nie znaleziono|не найден|доступ запрещ|ошибка \d+"
    r"|見つかりません|見つかりませんでした|アクセス(?:が|は)?(?:拒否|でき)|権限がありません|混み合って|お試しください|メンテナンス|エラー|利用できません|存在しません|未找到|找不到|无法访问",
)
# Shapes of stack frames.
FRAME = re.compile(r"(?:#\d+ |at [\w.$<>]+\(|File \"[^\"]+\", line \d+|in /\S+ on line \d+|(?:[\w-]*/)+[\w.-]+[:(]\d+\)?)")

# Words a notice that scripts or a browser check are needed is made of, by language.
_script = r"(?:java ?scripts?|scripts?|scripting|skripte|スクリプト)"
_act = r"(?:enable|activate|allow|needs?|needed|requires?|required|turn(?:ed)? (?:on|off)|switched off|disabled|does not support|aktivier\w*|benötigt|braucht|erforderlich|activer|activez|désactivé|besoin|nécessaire|activa|activar|habilit\w+|necesita|desactivado|必要|有効|無効)"
SCRIPTS = re.compile(rf"\b{_act}\b[^.!?。]{{0,40}}{_script}\b|{_script}[^.!?。]{{0,40}}\b{_act}\b|(?:スクリプト|javascript)[^。]{{0,12}}(?:必要|有効|無効)", re.I)
BROWSER_CHECK = re.compile(
    r"(?:check|verify)(?:ing)?\b[^.!?]{0,30}\b(?:your )?browser|browser wird[^.!?]{0,20}(?:ge|über)prüft|vérifi[^.!?]{0,30}navigateur|(?:comprob|verific)[^.!?]{0,30}navegador|ブラウザ[^。]{0,10}確認|(?:verify|confirm)[^.!?]{0,20} you are (?:a )?human",
    re.I,
)
# Every notice has one of these.
_hints = ("script", "skript", "スクリプト", "browser", "navigateur", "navegador", "ブラウザ", "human")
_w = re.compile(r"[^\W_]+")


def filler(line: str) -> bool:
    low = line.lower()
    words = _w.findall(low)
    return bool(SAMPLE.search(low)) or len(words) >= 3 and sum(w in LATIN for w in words) >= 0.8 * len(words)


def notice(text: str) -> bool:
    """Whether a short text tells that scripts or a browser check are needed."""
    if len(text) > 300:
        return False
    low = text.lower()
    for w in _hints:
        if w in low:
            return bool(SCRIPTS.search(low) or BROWSER_CHECK.search(low))
    return False


def hit(text: str) -> str:
    """What kind of residue a line's terms are of, if any."""
    if notice(text):
        return "notice"
    if filler(text):
        return "filler"
    return "error" if ERROR.search(text.lower()) or FRAME.match(text) else ""
