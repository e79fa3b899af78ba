"""Wordings held out from the grammar of siltstone.llm.residue.

MESSAGES by kind and SPEECH, lines of dialogue close to them, were written from general knowledge of the web,
of templates and of subtitles, before the grammar was, and not read off any test table; the list of known sentences that the
grammar replaced, which was, had been read before. FIRST holds what the grammar reached when it first met them.
"""

MESSAGES = {
    "error": [
        "408 Request Timeout", "410 Gone", "405 Method Not Allowed", "413 Payload Too Large", "451 Unavailable For Legal Reasons", "Error 522: Connection timed out", "HTTP 418 I'm a teapot", "HTTP/1.1 401 Unauthorized",
        "Oops! Something went wrong.", "Something went wrong, please try again later.", "Whoops, looks like something went wrong.", "An unexpected error has occurred.", "An error occurred while processing your request.", "We're sorry, an error has occurred.",
        "The page you requested was not found.", "This page does not exist.", "This page isn't available right now", "The requested URL was not found on this server.", "File not found.", "We couldn't find that page.", "Page cannot be displayed",
        "The page has been moved or deleted.", "The resource you are looking for has been removed or is temporarily unavailable.", "This video has been removed by the uploader", "This video is unavailable", "Video unavailable", "This file is no longer available",
        "The link you followed has expired.", "This site can't be reached", "Server not found", "The server is temporarily unable to service your request.", "The server encountered an internal error and was unable to complete your request.", "The connection has timed out",
        "Could not connect to the server.", "The connection was reset", "Unable to connect to database", "Database connection failed", "You don't have permission to access this page.", "You do not have permission to view this file", "You are not authorized to view this page.",
        "Permission denied", "Access to this page has been denied.", "Access to this resource is forbidden", "Your access to this site has been blocked.", "Your IP address has been blocked.", "You have been blocked", "Sorry, you have been blocked",
        "Please complete the CAPTCHA to continue.", "Please verify you are a human", "Confirm you are not a robot", "Checking your browser before accessing the site.", "Checking if the site connection is secure", "Unusual traffic from your computer network has been detected.",
        "Rate limit exceeded", "Too many requests. Please try again later.", "You have exceeded your download quota", "Download limit exceeded. Please wait 24 hours.", "Your session has timed out. Please sign in again.", "Please log in to view this content.", "You must be logged in to access this page",
        "This content is not available in your region.", "This service is not available in your country.", "The site is currently down for maintenance.", "Site under maintenance", "We are currently performing scheduled maintenance. Please check back soon.",
        "Warning: mysql_connect(): Access denied for user 'root'@'localhost'", "Fatal error: Call to undefined function get_header() in /var/www/html/index.php on line 12", "Parse error: syntax error, unexpected end of file in /home/web/a.php on line 3", "Traceback (most recent call last):",
        "java.lang.NullPointerException", "Uncaught TypeError: Cannot read property 'x' of undefined", "Request failed with status code 500", "Invalid request", "Bad request", "This account has been suspended", "Invalid or expired token",
        "If you are not redirected automatically, click here.", "Redirecting you to the requested page",
        "Página no encontrada", "Lo sentimos, la página que busca no existe.", "El archivo no existe o ha sido borrado", "Error interno del servidor", "Servicio no disponible", "No tiene permiso para acceder a esta página.", "Ha ocurrido un error. Inténtelo de nuevo más tarde.",
        "Page non trouvée", "La page demandée n'existe pas.", "Erreur interne du serveur", "Une erreur est survenue. Veuillez réessayer plus tard.", "Accès interdit", "Vous n'avez pas l'autorisation d'accéder à cette page.", "Vidéo indisponible",
        "Die Seite konnte nicht gefunden werden.", "Interner Serverfehler", "Ein Fehler ist aufgetreten.", "Diese Seite existiert nicht.", "Keine Berechtigung für diese Seite", "Die angeforderte Datei wurde gelöscht", "Der Server ist derzeit nicht erreichbar.",
        "Página não existe", "Erro interno do servidor", "Ocorreu um erro. Tente novamente mais tarde.", "Você não tem permissão para acessar esta página.", "O vídeo não está disponível", "Serviço indisponível",
        "Страница не существует", "Файл не найден", "Внутренняя ошибка сервера", "Произошла ошибка. Попробуйте позже.", "Сервис временно недоступен", "У вас нет доступа к этой странице",
        "ページが存在しません", "お探しのページは見つかりませんでした", "サーバーエラーが発生しました", "ファイルは削除されました", "الملف غير موجود", "حدث خطأ في الخادم", "الخدمة غير متوفرة حاليا",
        "Pagina non trovata", "Accesso negato", "Errore interno del server", "Pagina niet gevonden", "Toegang geweigerd",
    ],
    "script": [
        "JavaScript must be turned on to view this content", "You have JavaScript turned off.", "This site requires JavaScript to function properly.", "Your browser has JavaScript disabled.", "This page needs JavaScript", "Please turn JavaScript on and reload the page.",
        "JavaScript not enabled", "JavaScript is not supported by your browser", "Please allow cookies to continue", "Cookies must be enabled to use this site.", "Your browser does not support JavaScript!", "Sorry, you need JavaScript to watch this video.", "To use this website, enable scripts in your browser settings.",
        "You must enable JavaScript in order to use the player.", "This app works best with JavaScript enabled.", "For full functionality of this site it is necessary to enable JavaScript.", "Javascript is currently disabled. Please enable it for a better experience.", "Enable scripting and refresh", "We have detected that JavaScript is disabled in this browser.", "Captions cannot be loaded without JavaScript.",
        "Su navegador no admite JavaScript.", "Habilite JavaScript para continuar.", "JavaScript está desactivado.", "Esta página requiere JavaScript", "JavaScript est désactivé dans votre navigateur.", "Ce site nécessite JavaScript.", "Merci d'activer JavaScript",
        "JavaScript ist deaktiviert.", "Diese Anwendung benötigt JavaScript.", "Ihr Browser unterstützt kein JavaScript.", "Habilite o JavaScript no seu navegador.", "Seu navegador não suporta JavaScript.", "JavaScript отключен в вашем браузере.", "Ваш браузер не поддерживает JavaScript", "Для просмотра необходимо включить JavaScript.",
        "JavaScriptが無効になっています。", "このサイトではJavaScriptが必要です", "جافا سكريبت معطل في متصفحك", "يتطلب هذا الموقع جافا سكريبت", "Abilita JavaScript per continuare", "Schakel JavaScript in om verder te gaan",
    ],
    "filler": [
        "Your caption here", "Insert caption here", "Enter your text here", "Enter text", "Type something here", "Caption goes here", "Subtitle text here", "Title goes here", "Placeholder text", "Dummy text", "Sample caption 4", "Example subtitle", "Sample text for testing",
        "This is a sample subtitle", "This is dummy text.", "This text is a placeholder", "Text to be added", "Translation to be added later", "Caption to follow", "Subtitle not yet translated", "Replace this text", "Replace with your own text", "Double click to edit", "Click to add text", "Click to add title", "Test subtitle 1", "Test caption", "[TO BE TRANSLATED]",
        "Escriba su texto aquí", "Inserte el texto aquí", "Texto de relleno", "Texto de prueba", "Subtítulo de ejemplo", "Insérez votre texte ici", "Texte de remplissage", "Votre texte ici", "Exemple de sous-titre", "Text hier einfügen", "Ihr Text hier", "Hier steht Ihr Text", "Beispieluntertitel", "Digite seu texto aqui", "Seu texto aqui", "Legenda de exemplo", "Texto de teste",
        "Пример текста", "Введите текст здесь", "Ваш текст здесь", "Тестовый субтитр", "ここにテキストを入力してください", "サンプルテキスト", "أدخل النص هنا", "نص للتجربة", "Testo di esempio", "Inserisci il testo qui",
    ],
    "placeholder": [
        "{{ user.name | upper }}", "<?php echo $x ?>", "{{#each cues}}", "{{/if}}", "{{> header}}", "{% if user %}", "{% for x in cues %}", "{{ 'key' | translate }}", "${user.name}", "#{episode_title}", "<%= @title %>", "%{count} views", "{{cue.text[0]}}",
        "[Your Name]", "[INSERT NAME]", "[title here]", "<<TITLE>>", "@@NAME@@", "__TITLE__", "%SHOW_TITLE%", "{{title|default:'x'}}", "{{{body}}}", "<#list cues as c>", "Hello {first_name}, welcome",
    ],
}

SPEECH = [
    "I couldn't find the page you tore out.", "The page was missing from her diary.", "Nobody found the file on my desk.", "Turn to page 404, please.", "We drove 404 miles for this?", "There were 502 sheep in the field.", "He owes me 500 dollars.", "403 days without rain.", "Room 404 is at the end of the hall.", "The bus 503 leaves at noon.",
    "Access denied? But I work here!", "They denied me access to my own house.", "Permission denied, said the guard, and he laughed.", "You don't have permission to speak.", "You have no permission to enter my room.", "I'm sorry, this seat is no longer available.", "Sorry, the doctor is not available.", "She is not available for dinner.", "The king is unavailable.", "Your table is no longer available, madam.",
    "Something went wrong with the engine.", "Something went wrong last night, didn't it?", "If something goes wrong, call my brother.", "It was an honest error.", "Trial and error, my friend.", "The error was mine.", "There was an error in the letter I sent you.", "He made an error on line 12 of the poem.", "Error after error, and still he plays.", "I found the error in your calculation.",
    "The connection was bad, I couldn't hear her.", "I lost the connection to my family.", "We lost connection with the boat.", "The server spilled the soup on my lap.", "Our server was rude, and the food cold.", "The service here is terrible.", "The service was lovely, vicar.", "The bridge is closed for maintenance.", "Maintenance came and fixed the lift.", "The road is blocked.",
    "He blocked me on the stairs.", "You have been warned.", "Sorry, you have been replaced.", "Are you a human or a robot?", "I am not a robot, I have feelings.", "Verify your story before you print it.", "Too many requests for the same song.", "Too many questions, detective.", "Try again later, kid.", "Please wait here, sir.",
    "The session is over, please leave.", "My session with the therapist timed out.", "Log in the fire, please.", "We need to log every visitor.", "Click here, he said, and the light went on.", "Click, click, nothing.", "Your account of the events has holes.", "The account was empty.", "My account has been suspended, says the bank. What now?", "The video shows a man in a hat.",
    "I deleted the video before she saw it.", "The video was removed from the evidence room by the captain.", "They removed the file from the archive last winter.", "The archive burned down.", "This country is not available to people like us.", "In your country, is it always this cold?", "The gate is forbidden to children.", "It is forbidden to love her.", "Forbidden fruit tastes better.", "Bad request, good heart, that's my uncle.",
    "A bad gateway, that's what the old men called this pass.", "The gateway to the east is open.", "Not found, not lost, just resting.", "He was not found guilty.", "Her keys were not found until spring.", "The treasure could not be found on any map.", "The captain could not be found, so we sailed.", "Page me when you find the doctor.", "Page, bring my horse!", "The requested song, ladies and gentlemen.",
    "I learned JavaScript in a week.", "JavaScript is not Java, my dear.", "She wrote the script in JavaScript.", "Do you need JavaScript for that job?", "My boss said I need JavaScript and patience.", "You told me to enable JavaScript, and look what happened.", "We use JavaScript at work, mostly.", "He turned the script off stage and smiled.", "The script requires a kiss in act two.", "Actors must follow their scripts.",
    "This script needs work.", "Read the script again, from the top.", "Nobody enabled him but his mother.", "Cookies are in the jar, please take one.", "Please enable your sister to study.", "You need to allow yourself some cookies.", "I allow cookies after dinner only.", "My browser at the shop was a tall man.", "I was only browsing, thanks.", "The player needs new shoes.",
    "Java is an island, he insisted.", "Scripts! Everybody wants scripts!", "He disabled the alarm.", "The alarm is disabled, go.", "I switched it off and reloaded the gun.", "Refresh my memory, please.", "To continue, we must cross the river.", "Reload! Reload!", "The subtitles are wrong, look at them.", "I can't read the subtitles from here.",
    "Text me when you get there.", "Your text made me cry.", "Your text arrived at midnight.", "The text here is in Latin, Professor.", "Here, take the text and read.", "Insert the coin here, miss.", "Insert the key and turn.", "Enter here, and mind the step.", "Type it up and send it to the judge.", "She's not my type.",
    "Add salt, then the onions.", "Add my name to the list.", "Sample the wine first.", "A sample of his handwriting, please.", "Don't be a dummy.", "The dummy in the window moved!", "I'm just a placeholder until the king returns.", "He used me as a placeholder at the table.", "This is a test, do not panic.", "Test the rope before you climb.",
    "The title goes to the man in red.", "Where does this line go? Here?", "Line 12 of the metro is closed.", "The line goes dead here.", "This is a line from a play.", "Your line, Brenda! Say your line!", "The caption under the photo said 1912.", "Translate this for the Ambassador.", "To be translated, a book must be loved.", "To be or not to be.",
    "Replace the bulb in the hallway.", "Replace me? With whom?", "Edit your words, boy.", "Example? I'll give you an example.", "For example, my aunt.", "Lorem was the name of our cat.", "He whispered ipsum, or something Latin.", "Dolor means pain in Latin.", "Lorem ipsum, the monks joked, is all we copy.", "We printed lorem ipsum on the menus by mistake!",
    "No encontré la página del diario.", "La página del diario no fue encontrada hasta abril, señora.", "El acceso al puente está cerrado.", "Me negaron el acceso a la casa.", "Ha ocurrido un milagro.", "Fue un error quererte.", "El servicio en este hotel es malo.", "Escribe tu nombre aquí, por favor.", "Aquí no hay nadie.", "Mi hermano escribe guiones.",
    "Je n'ai pas trouvé la page.", "La page est tournée, mon ami.", "On m'a refusé l'accès au château.", "C'est une erreur de jeunesse.", "Le service est compris.", "Écrivez votre nom ici.", "Ici, le texte est illisible.", "Le fichier est dans ma voiture.", "Activez-vous, les enfants !", "J'apprends JavaScript le soir.",
    "Ich habe die Seite nicht gefunden.", "Auf der anderen Seite des Flusses.", "Ihm wurde der Zugriff auf das Erbe verweigert, sagt sie.", "Das war ein Fehler von mir.", "Der Dienst beginnt um acht.", "Hier ist dein Text, lies ihn vor.", "Die Datei liegt auf dem Tisch.", "Ich lerne JavaScript.", "Schreiben Sie hier Ihren Namen.", "Sein Blindtext war besser als mein Roman.",
    "Não encontrei a página do livro.", "O acesso à praia foi negado, acredita?", "Foi um erro meu.", "O serviço aqui é lento.", "Escreva seu nome aqui.", "Eu estudo JavaScript à noite.", "Я не нашёл эту страницу.", "Мне запретили доступ к архиву, представляешь?", "Это моя ошибка.", "Файл лежит у меня на столе.",
    "Введите арестованного!", "Он учит JavaScript по ночам.", "Текст письма здесь, читай.", "Служба кончилась.", "そのページは破れていた。", "彼はJavaScriptを勉強している。", "それは私のエラーだった。", "ここに名前を書いて。", "لم أجد الصفحة في الكتاب", "كان ذلك خطأ مني", "أخي يدرس جافا سكريبت", "اكتب اسمك هنا",
    "{LAUGHING}", "{sobbing quietly}", "[DOOR SLAMS]", "[Your Honor laughs]", "[music here and there]", "{\\an8}Somewhere in Ohio", "{y:i}My dear friend", "$5 and $6 make $11.", "50% of 100% is plenty.", "He said 20%, I said 30%.", "<i>Look at me</i>", "<b>STOP</b>", "C'est #1!", "a < b and b > c, children.", "email me @ home @ night", "1 << 2, said the robot",
    "__", "{}", "[]", "%", "*** sighs ***", "- No. - Yes.", "♪ la la la ♪", "<font color=\"red\">Run!</font>",
]

#: Written after the grammar had been mended by what it missed above, and met by it once, unchanged.
LATER = {
    "error": [
        "The requested page could not be found.", "Error: 500 Internal Server Error", "This link is invalid or has expired.", "Sorry, this page isn't available.", "Requested file was not found on the server.", "The service is unavailable.", "403 - Forbidden: Access is denied.", "Your request could not be processed.", "An internal error occurred.", "Access is restricted",
        "Please sign in to continue", "Too many failed login attempts.", "This account does not exist.", "The database server is not responding.", "Web server is returning an unknown error", "Please prove you are not a robot.", "You are being redirected...", "Media could not be loaded, either because the server or network failed.", "Esta página no está disponible.", "El servidor no responde.",
        "Esta cuenta ha sido suspendida.", "Le serveur est indisponible.", "Cette vidéo n'est plus disponible.", "Ce lien a expiré.", "Die Verbindung wurde unterbrochen.", "Dieses Video ist nicht verfügbar.", "Zu viele Anfragen", "Esta página não está disponível.", "O link expirou.", "Страница удалена", "Видео недоступно", "Слишком много запросов", "このページは表示できません", "アクセスが禁止されています", "هذه الصفحة غير متوفرة", "Questa pagina non esiste", "Deze pagina bestaat niet",
    ],
    "script": ["This website needs JavaScript enabled.", "Turn on JavaScript in your browser to continue.", "Scripts are disabled.", "Sorry, this page requires scripts.", "Please enable cookies and reload the page.", "Este sitio necesita JavaScript.", "Autorisez JavaScript puis rechargez la page.", "Bitte JavaScript aktivieren", "Este site precisa de JavaScript.", "Пожалуйста, включите JavaScript.", "JavaScriptをオンにしてください", "فعل جافا سكريبت"],
    "filler": ["Add your text here", "Insert your caption here.", "Sample title", "Placeholder for subtitle", "Dummy line", "Add a caption", "Your subtitle goes here", "Ingrese su texto aquí", "Texte provisoire", "Hier Text eingeben", "Platzhaltertext", "Texto aqui", "Insira seu texto aqui", "Вставьте текст", "ダミーテキスト", "اكتب النص هنا"],
    "placeholder": ["{{username}}", "{{ page.title | escape }}", "{% endif %}", "${episodeTitle}", "[INSERT DATE]", "<<NAME>>", "%(name)s", "[Your Title]"],
}
LATER_SPEECH = [
    "The page fell out of the book.", "We could not find the site where he died.", "Is there a service on Sunday?", "The file on Marlow is thin, inspector.", "Nobody has access to the vault but us.", "Access the roof from the stairs.", "The door denied us entry.", "That was an error of judgement.", "What error?", "The limit is two per customer.", "We reached the limit of our patience.", "Sign in, please, then follow the nurse.",
    "Are we under attack?", "The server dropped the tray.", "Is this the right site?", "The account is settled, ma'am.", "We lost the session, your honour.", "Robots will rule us all.", "The script is a mess.", "Enable the shields!", "Disabled or not, she won the race.", "Turn it off and come to bed.", "The browser bought nothing.", "Is it required, sir?", "Text here, text there, text everywhere!", "The sample is contaminated.", "Type faster!", "Enter, stranger.",
    "Your line was better.", "Here lies your father.", "The translation is poor.", "Where is your subtitle, poet?", "La página está rota.", "El archivo de la policía está cerrado.", "Le service est fini, rentrez.", "Der Server im Lokal war langsam.", "Страница книги порвана.", "Доступ к морю открыт.", "その字幕は変だ。", "الصفحة ممزقة",
]
#: (share of messages found as a cue of a dialogue, lines of dialogue taken for messages) at the first meeting.
#: Both sets have been seen since, so what tests hold the grammar to is no held-out figure any more.
FIRST, FIRST_LATER = (0.914, 3), (0.822, 0)
