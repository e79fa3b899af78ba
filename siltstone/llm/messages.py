"""The vocabulary of system messages, script notices and filler lines, and the rules over it.

A fragment is judged by what it is composed of, not by known sentences: each word stands for concepts
(a thing served, a failure, a script, a request to switch something on, ...), a rule names the concepts
that make a message of a kind, and nearly all other words must be ones that such messages consist of.
Speech about the same matters brings words of its own, or a speaker ("I", "said"), and is none.

Words are given per concept in their plain spelling; `word*` (five letters at least) stands for all words that begin so. They
are compared in a folded form (see `siltstone.llm.residue`) in which accents, case and common
recognition errors do not matter.
"""

from __future__ import annotations

CONCEPTS = {
    # things a server hands out or is asked for
    "thing": "page pages webpage url urls link links site sites website websites file files video videos content contents resource resources document documents subtitle subtitles caption captions episode stream media player app application browser program module plugin account session "
    "server servers service services connection database host domain address ip token request requests gateway proxy download downloads "
    "página páginas enlace sitio archivo archivos contenido recurso documento vídeo subtítulo subtítulos servidor servicio conexión solicitud cuenta sesión descarga descargas "
    "lien fichier fichiers contenu ressource vidéo serveur connexion requête compte lecteur sous-titres téléchargement téléchargements "
    "seite seiten webseite datei dateien inhalt inhalte dienst verbindung anfrage konto sitzung untertitel anwendung "
    "ficheiro arquivo conteúdo serviço conexão pedido conta sessão legenda legendas pagina sito contenuto servizio bestand "
    "страниц* файл* сайт* сервер* сервис* видео контент* ресурс* ссылк* сесси* субтитр* "
    "ページ ファイル サイト サーバー サーバ サービス 動画 コンテンツ リンク صفحة ملف موقع خادم خدمة فيديو محتوى رابط مورد",
    "not": "not no nor cannot cant don doesn isn couldn wasn didn hasn aren won wouldn haven unable without no sin non ne pas n kein keine keinen nicht não niet не нет нельзя ません ない 見つかりません 見つかりませんでした 利用できません できません 見つから غير تعذر لا لم ليس",
    "connect": "processed respond responds responding responde répond antwortet risponde отвечает connect connected load loaded open opened complete completed service fulfil fulfill process handle conectar cargar abrir charger ouvrir connecter laden öffnen verbinden carregar abrir caricare подключ* загруз* откры* 接続 読み込め 表示 応答 الاتصال تحميل",
    "there": "found find exist exists existed displayed reached reachable encontrado encontrada encontrados existe trouvé trouvée trouver existe gefunden existiert erreichbar erreicht encontrada existe trovato trovata esiste gevonden bestaat "
    "найден* существует найти 見つかりません 見つかりませんでした 見つから 存在 موجود موجودة العثور يوجد",
    "usable": "available disponible disponibles verfügbar disponível disponibile beschikbaar доступен доступна доступно 利用できません 利用 متوفر متوفرة متاح متاحة",
    "fails": "expir* suspend* interrupt* interrump* interromp* unterbrochen getrennt bloque* elimin* supprim* desactiv* désactiv* unavailable unreachable removed deleted expired suspended blocked timed timeout moved disconnected terminated reset refused corrupt corrupted "
    "eliminado eliminada borrado borrada caducado caducada expirado expirada suspendido suspendida bloqueado bloqueada introuvable indisponible supprimé supprimée effacé expiré expirée suspendu bloqué bloquée "
    "entfernt gelöscht abgelaufen gesperrt blockiert unerreichbar removido removida apagado apagada indisponível excluído excluída rimosso rimossa verwijderd "
    "удал* недоступ* заблокирован* истек* приостановлен* 削除 期限切れ 停止 حذف محذوف محذوفة معطلة انتهت",
    "access": "access permission permissions authorized authorised authorization privileges acceso permiso permisos autorizado accès autorisation autorisé zugriff berechtigung berechtigungen zugang acesso permissão autorização autorizado accesso permesso toegang "
    "доступ* прав разрешени* アクセス 権限 الوصول وصول صلاحية إذن",
    "denied": "denied forbidden refused restricted blocked denegado prohibido rechazado refusé interdit verweigert verboten negado proibido negato vietato geweigerd запрещ* отказан* 拒否 禁止 رفض مرفوض ممنوع",
    "error": "error errors erreur fehler erro errore fout exception fatal failed failure fallo échec fehlgeschlagen falha serverfehler ошибк* сбой エラー خطأ",
    "happened": "internal unexpected unknown occurred encountered processing establishing connecting interno interna ocurrido inesperado producido interne survenu survenue produite inattendue interner internen aufgetreten unerwarteter ocorreu inesperado "
    "внутренн* произошл* неизвестн* 発生 内部 حدث داخلي",
    "wrong": "wrong",
    "apology": "sorry oops whoops please again later",
    "bad": "bad invalid malformed",
    "human": "human robot robots captcha bot bots humano robot humain mensch roboter человек* робот* ロボット",
    "verify": "verify verifying confirm complete prove checking check verifique confirme vérifiez confirmez bestätigen verifizieren подтвердите 確認",
    "limit": "attempt attempts intentos tentatives versuche tentativas попыт* anfragen requêtes solicitudes pedidos richieste запрос* リクエスト limit limits quota rate requests traffic downloads límite limite limites quota grenze cota лимит*",
    "exceeded": "too demasiad* trop viele zu troppe muitas muitos много слишком 多すぎ exceeded reached many unusual slow superado alcanzado excedido atteint atteinte dépassé überschritten erreicht excedido atingido ultrapassado превышен* исчерпан*",
    "login": "login anmelden einloggen connecter identifier войдите войти авториз*",
    "go_on": "continue proceed view access accessing watch see secure continuar ver continuer voir fortfahren sehen просмотр* продолж*",
    "redirect": "redirecting redirected redirect redirigiendo redirection redirigé weiterleitung weitergeleitet redirecionando redirecionado перенаправлени*",
    "ongoing": "performing scheduled under down currently soon undergoing curso cours derzeit geplante geplant programado programada проводятся проводится",
    "upkeep": "maintenance mantenimiento wartung wartungsarbeiten manutenção manutenzione обслуживани* メンテナンス صيانة",
    "script": "javascript js ecmascript scripts scripting skripte skripten скрипт* джаваскрипт* スクリプト جافا سكريبت جافاسكريبت",
    "cookies": "cookies cookie",
    "enable": "enable enabled enabling activate activated turn turned switch switched allow allowed permit habilit* reactiv* réactiv* autoris* active activar activado activo permita activer activez activé autoriser autorisez activés actifs actif aktivieren aktiviert aktivieren einschalten eingeschaltet erlauben erlaubt zulassen "
    "ative ativar ativado habilitado permita abilita abilitare attiva schakel inschakelen включ* разреш* 有効 オン تفعيل تشغيل تمكين فعل",
    "disabled": "disabled deactivated off desactivado deshabilitado désactivé deaktiviert ausgeschaltet desativado desabilitado disabilitato disattivato uitgeschakeld отключ* выключ* 無効 オフ معطل معطلة",
    "required": "require requires required need needs needed must necessary requiere requieren necesario necesaria necesita precisa besoin nécessite nécessaire requis doit doivent benötigt benötigen erfordert erforderlich braucht muss müssen requer necessário precisa richiede necessario vereist nodig "
    "нужн* необходим* требует* 必要 يتطلب مطلوب يجب يرجى",
    "support": "support supports supported soporta admite compatible supporte charge unterstützt unterstützen suporta supporta поддержива* サポート 対応 يدعم",
    "text": "text texts texto textos texte testo tekst title titles título titre titel titolo caption captions subtitle subtitles sous-titre untertitel subtítulo legenda sottotitolo translation "
    "текст* субтитр* заголовок テキスト 字幕 タイトル نص النص الترجمة ترجمة عنوان",
    "line": "line lines línea ligne zeile zeilen linha строк* 行",
    "sample": "sample samples dummy placeholder placeholders example test filler temporary prueba ejemplo relleno provisional exemple factice remplissage provisoire teste exemplo provisório esempio prova voorbeeld тестов* образец пример* заглушк* サンプル テスト ダミー تجريبي تجريبية مثال للتجربة",
    "stand_in": "placeholder placeholders platzhalter marcador заглушк* プレースホルダー",
    "this": "this esto este ceci dies dieses das isto это これは هذا",
    "sample_text": "blindtext beispieltext beispieltexte beispieluntertitel mustertext platzhalter platzhaltertext platzhalterzeile fülltext testtext testuntertitel строка-заглушка サンプルテキスト",
    "enter": "insert enter type write add edit replace click inserte escriba escribe introduzca ingrese añada insérez saisissez entrez tapez ajoutez eingeben einfügen einfügen schreiben digite insira escreva adicione inserisci scrivi введите вставьте напишите 入力 أدخل اكتب ادخل",
    "here": "here aquí ici hier aqui qui здесь сюда ここに ここ هنا",
    "your": "your own su tu votre ton ihr ihre ihren dein seu sua il tuo ваш* あなた",
    "placed": "goes go be follow translated added steht kommt inserted traducir traduire übersetzen traduzir перевод* перевест*",
    "later": "be to follow yet",
    "you": "you your youre usted vous sie você вы вас 様 أنت",
}
#: Words that messages hold besides; they stand for no concept.
PLAIN = """
the a an is are was were be been being has have had it its this that these those there to of for in on at by from with and or if so as we us our ve s ll re t d l m u please sorry oops whoops oh but can could will would may might should
do does did some any all other currently temporarily temporary permanently now again later soon back before after while when which who where moment minute minutes hour hours second seconds day days daily time long longer more too very just only
look looks looking like went something went gone uploader owner user admin administrator automatically immediately shortly trying try wait retry reload refresh reloading load loaded loading requested requesting get down up out under complete
work works working properly correctly full fully functionality function functions best better experience use used using order browser browsers device computer network system settings setting secure security security country region area ip
version newer older mode run running perform performing scheduled performed check detected detect detection code status http https message reference id line number attempt attempts your yours view viewing see seeing watch watching play played playing
display shown show process processing uncaught able unable followed follow submitted provided been lost reset refused closed took respond response responding responded because due through via
de la el los las un una unos unas en del al y o que se ha han sido lo le les por para con su este esta esto sentimos favor vuelva intente inténtelo nuevo más tarde está esta ser fue busca buscando acceder internet visualizar
le la les un une des du au aux et ou que qui ce cet cette est sont a été pour avec dans sur sous vous nous il elle désolé veuillez réessayer plus tard demandée demandé réessayez merci afin ci afficher avez accéder temporairement momentanément
der die das den dem des ein eine einen einem einer und oder ist sind war wurde wurden wird werden kann können konnte konnten um zu zum zur für auf in im mit von bei bitte leider es ihr ihre ihren ihrem diese dieser dieses dass derzeit vorübergehend momentan später erneut versuchen angeforderte angeforderten gesuchte
o os as um uma no na nos nas do da dos das e ou que se foi são para por com seu sua este esta isto tente novamente mais tarde desculpe favor você tem está acessar possível temporariamente solicitado solicitada
il lo gli i una per di non è sono stato questa questo questo riprova più tardi deze dit het een is niet voor verder gaan om te in uw
для в на с и по из к у этой этого этот эта это был была было были чтобы вашем ваш вам вас вы браузер* попробуйте позже временно пожалуйста увидеть просмотра работы запрошенн* еще раз снова повторите скачивани* сети
は が を に で の と も へ から まで する した して ください なって います されました しました でした お探し この その ブラウザ 続行 表示 ため お使い 現在 後で もう一度 手続き お試し
في من إلى على عن هذا هذه تم قد لعرض حاليا الآن حدث المطلوبة المطلوب متصفحك المتصفح لك لديك يرجى أو و مرة أخرى لاحقا
returning returns puis rechargez recargue recarregue laden neu zu viele trop demasiados muitos слишком много returned
right testing purposes purpose only about info information details detail support contact help team back home return go homepage start directory list file name
tiene tienes tenga tenemos puede pueden podido hemos debe deben sitio momento continuar página error hay ningún ninguna
continuare proseguire accedere visualizzare è essere sono possibile impossibile browser il tuo
sein haben hat habe dieser seite nicht mehr wir sie jetzt schalten sie neu laden damit nutzen verwenden besuchen
peut peuvent doit être utiliser plus titres sous trouver trouvons nous votre réactivez rechargez rien ici
pode podem possível precisa estar não mais foi nós encontramos encontrar carregue
может могут должен быть больше мы не вы у нас этом этого работа сайтом страницы включен включены требуется использовать
browser navegador navigateur funciona funcionar fonctionner funktionieren funktioniert ordnungsgemäß richtig siten correctamente correctement sichtbar anzuzeigen anzeigen ansehen carregar charger laden einstellungen configuración ativo activos activas
"""
#: Reason phrases of the 4xx and 5xx statuses as registered, and as proxies word them; with a status number they are messages. Fixed values.
REASONS = (
    "bad request; unauthorized; payment required; forbidden; not found; method not allowed; not acceptable; proxy authentication required; request timeout; request time out; conflict; gone; length required; precondition failed; payload too large; "
    "content too large; request entity too large; uri too long; unsupported media type; range not satisfiable; expectation failed; i m a teapot; misdirected request; unprocessable content; unprocessable entity; locked; failed dependency; "
    "too early; upgrade required; precondition required; too many requests; request header fields too large; unavailable for legal reasons; internal server error; not implemented; bad gateway; service unavailable; gateway timeout; gateway time out; "
    "http version not supported; variant also negotiates; insufficient storage; loop detected; not extended; network authentication required; web server is down; connection timed out; origin is unreachable; a timeout occurred"
)
#: A kind's rules: the concepts that must all be there ("a|b": one of them, "#": a number from 400 to 599, "##": any number), and whether the
#: fragment must be all the text holds, because a dialogue could have it.
RULES = [
    ("script", "script enable", False), ("script", "script disabled", False), ("script", "script required", False), ("script", "script support not", False), ("script", "script not thing", False),
    ("script", "cookies enable required|go_on|you", False), ("script", "cookies enable", False), ("script", "cookies disabled", False),
    ("error", "thing not there|usable", False), ("error", "thing fails", False), ("error", "access denied", False), ("error", "thing denied", False), ("error", "access not thing|go_on", False), ("error", "you fails", True),
    ("error", "error happened", False), ("error", "error thing", False), ("error", "# error", False), ("error", "# thing not|fails|bad|denied|happened", False), ("error", "# not there", False), ("error", "# denied|fails", False), ("error", "bad thing", False),
    ("error", "verify human", False), ("error", "verify thing go_on", False), ("error", "limit exceeded", False), ("error", "login go_on|thing", False), ("error", "redirect", False), ("error", "thing upkeep", False), ("error", "upkeep ongoing", False), ("error", "thing not connect", False), ("error", "upkeep you", True), ("error", "wrong apology", False), ("error", "wrong", True), ("error", "not there", True), ("error", "access not", True),
    ("filler", "sample text|line", False), ("filler", "sample_text", False), ("filler", "stand_in this", False), ("filler", "enter text here", False), ("filler", "enter text your", False), ("filler", "enter here", True), ("filler", "enter text", False), ("filler", "text your here", False), ("filler", "text placed here", False), ("filler", "text|line later placed", False), ("filler", "text placed", True), ("filler", "text your", True), ("filler", "text here", True), ("filler", "placed later", True), ("filler", "sample", True), ("filler", "line your", True),
]
#: Words of somebody who speaks; no message holds them.
SPEAKERS = "i my me mine myself he she him her his hers they them said says told asked dear yo mi mí je mon ma mes moi ich mein meine mich mir er mich eu meu minha ele ela я мне мой моя мне меня он она io mio mia"
