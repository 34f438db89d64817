"""Labelled exemplars of texts that nobody wrote: templates, filler, error pages, notices about scripts."""

from __future__ import annotations

# What the slots and stand-ins of record templates are called.
NAMES = ["summary", "diagnosis", "error", "module", "component", "root cause", "test name", "fix", "owner", "target", "goal", "ticket", "title", "description", "name",
         "reason", "status", "date", "author", "steps", "result", "text", "details", "comment", "subject", "message", "project", "version"]
KINDS = ["sample", "dummy", "placeholder", "default", "some", "example", "test", "filler", "template"]
THINGS = ["text", "copy", "content", "entry", "paragraph", "description", "title", "value", "data", "summary"]
ENDINGS = ["goes here", "to be replaced", "replace me", "for layout only", "(do not publish)", ", please overwrite", "only", "here"]
STANDINS = ["TBD", "TODO", "FIXME", "coming soon", "to be filled in later", "to be determined", "to be announced", "fill this in", "fill in later", "add text", "add text here", "insert text here",
            "lorem ipsum", "replace this text", "change me", "xxx", "your text here", "write something here", "no text yet", "content missing", "untitled", "under construction",
            "hier text einfügen", "platzhalter", "texte à remplacer", "texte ici", "texto aquí", "texto de ejemplo", "insira o texto aqui", "texto de exemplo", "вставьте текст", "здесь будет текст",
            "此处填写内容", "待补充", "待定", "ここにテキストを入力"]
# The usual filler vocabulary; each word alone is filler.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco "
    "laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum eget nec orci porta massa vita vitae temp eius aliquam ullam nostrum bla blah yada foo bar baz qux quux asdf qwerty tbd todo fixme"
).split()
TEMPLATES = ["{x}", "The failure in {x} is caused by {x}.", "{x} broke because of {x}; see {x} for details.", "Dear {x}, the run ended with {x}.", "Summary: {x} / {x}", "Diagnosis: {x}", "Cause: {x} Fix: {x}",
             "Owner {x}, component {x}, reason {x}", "# Diagnosis {x} # Evidence {x}", "Describe what went wrong here: {x}", "During the nightly run {x} stopped with {x}, likely owing to {x}.",
             "The reader of {x} has to be changed as described in {x} before the next release.", "As a {x} I want {x} so that {x}", "Task {x}: describe what must be done", "Goal: {x}", "Implement {x} so that {x}",
             "Fix {x} in {x}", "Explain {x} to {x}", "Investigate {x} for {x}", "Make {x} in {x} tolerate a stale cache", "Hello {x}, your {x} is ready", "Please {x} the {x}", "Steps to reproduce: {x} Expected: {x} Actual: {x}",
             "Title: {x} Description: {x}", "Given {x} when {x} then {x}", "See {x} for more information about {x}", "Name: {x} Date: {x}", "{x} failed with {x} on {x}", "Reported by {x} on {x}", "Replace {x} with {x}",
             "Root cause: {x} Resolution: {x} Owner: {x}", "Update {x} to {x}", "Upgrade {x} to {x} and repair what breaks", "Add {x} to {x}", "Remove {x} from {x}", "Write {x} for {x}", "Status: {x} Error: {x} Module: {x}"]
STATUS = ["Bad Request", "Unauthorized", "Forbidden", "Not Found", "Method Not Allowed", "Request Timeout", "Request Time-out", "Conflict", "Gone", "Payload Too Large", "Too Many Requests", "Internal Server Error",
          "Not Implemented", "Bad Gateway", "Service Unavailable", "Service Temporarily Unavailable", "Gateway Timeout", "Gateway Time-out", "Access Denied", "Page Not Found"]
STATUS_FORMS = ["{n} {s}", "Error {n}: {s}.", "HTTP Status {n} – {s}", "HTTP/1.1 {n} {s}", "{n} | {s} |", "Oops, error {n} ({s})!", "Server returned {n} {s}.", "HTTP error {n}: {s}", "{s} ({n})", "{n} error {s}", "{s}. The server", "{s}. You", "{n} {s}: you"]
AFTERMATH = ["Please try again later.", "Please try again in a few minutes.", "Contact the administrator if this persists.", "Go back to the home page.", "Back to home", "That's all we know.", "Request id {i}", "Incident {i}", "Reference #{i}",
             "Ray {i}", "Ray ID: {i}", "Error code {i}", "{h} could not be loaded.", "The server at {h} did not answer in time.", "{server}", "HTTP server at {h} port {n}", "nginx {server}", "Apache server at {h} Port {n}"]
STATUS_TAILS = ["{server}", "Incident {i}", "Request id {i}"]
PAGES = ["upstream connect error or disconnect/reset before headers. reset reason: overflow", "reset reason: connection failure", "reset reason: connection termination", "reset reason: local reset", "no healthy upstream",
         "Too Many Requests: you have been rate limited, retry after {n} seconds", "Oops! That page can't be found. It looks like nothing was found at this location. Back to home",
         "Internal Server Error. The server encountered an unexpected condition. Error code {i}", "The server encountered an internal error and was unable to complete your request.",
         "Sorry, something went wrong on our end. We're working on it. [Go back]", "Something went wrong. Please try again later.", "Access denied. You don't have permission to access this resource. Reference #{i}",
         "You don't have permission to access {p} on this server.", "Forbidden You are not authorised to view {p} on this server. HTTP server at {h} port {n}", "The requested URL {p} was not found on this server.",
         "Application error: a client-side exception has occurred (see the browser console for more information).", "This site can't be reached. {h} refused to connect. Try: checking the connection, checking the proxy and the firewall ERR_CONNECTION_REFUSED",
         "{h} refused to connect. Try: - checking the connection - checking the proxy and the firewall - running network diagnostics", "{h} took too long to respond.", "DNS_PROBE_FINISHED_NXDOMAIN", "This request was blocked by the site owner. Ray {i}",
         "Error {n} - this request was blocked by the site owner. Ray {i}", "Checking your browser before you proceed to {h} This may take a few seconds.", "Checking if the site connection is secure", "Verify you are human by completing the action below",
         "Just a moment...", "Attention required!", "Site under maintenance. We will be back soon.", "We are performing scheduled maintenance. Please check back later.", "Your session has expired. Please log in again.", "The page you are looking for does not exist or has been moved.",
         "The page you requested could not be found.", "The service is temporarily unavailable due to maintenance downtime or capacity problems.", "Erreur {n} : une erreur interne est survenue, veuillez réessayer plus tard.", "Page introuvable. La page demandée n'existe pas ou plus.", "Accès refusé. Vous n'avez pas l'autorisation d'accéder à cette page.",
         "Página no encontrada. El enlace que ha seguido puede estar roto.", "Error interno del servidor. Inténtelo de nuevo más tarde.", "Acceso denegado. No tiene permiso para acceder a este recurso.",
         "Página não encontrada. O link que você seguiu pode estar quebrado.", "Erro interno do servidor. Tente novamente mais tarde.", "Acesso negado. Você não tem permissão para acessar esta página.", "Serviço indisponível. Tente novamente mais tarde.",
         "Seite nicht gefunden (Fehler {n}). Die angeforderte Seite existiert nicht mehr.", "Interner Serverfehler. Bitte versuchen Sie es später erneut.", "Zugriff verweigert. Sie haben keine Berechtigung, auf diese Seite zuzugreifen.", "Dienst nicht verfügbar. Bitte versuchen Sie es später erneut.",
         "Страница не найдена. Возможно, ссылка устарела или страница была удалена.", "Ошибка {n}. Страница не найдена. Внутренняя ошибка сервера. Попробуйте позже.", "Доступ запрещён. У вас нет прав для просмотра этой страницы.", "Сервис временно недоступен. Повторите попытку позже.",
         "页面未找到。您访问的页面不存在或已被删除。", "服务器内部错误，请稍后再试。", "抱歉，您访问的页面不存在。", "访问被拒绝。您没有权限访问此页面。", "服务暂时不可用，请稍后重试。", "无法访问此网站", "ページが見つかりません。",
         "We'll be back soon! The site is down for scheduled maintenance.", "Your session has expired. Please sign in again to view this page.", "You have been logged out.", "This content is not available in your region."]
SCRIPT_ACTIONS = ["enable JavaScript", "activate JavaScript and cookies", "turn on scripts", "switch scripts back on", "allow scripting", "disable your script blocker", "allow scripts", "turn on JavaScript", "enable scripts and cookies", "enable cookies"]
SCRIPT_OPENINGS = ["Please {a}", "Notice: {a}", "You need to {a}", "To continue, {a}", "In order to view this page, {a}", "This report is interactive; {a}", "To use this site, {a}", "You must {a}", "We're sorry but this app doesn't work properly without JavaScript. Please {a}"]
SCRIPT_ENDINGS = ["in your browser", "in the settings", "for {h}", "(code {i})", "to continue", "and reload.", "to see the content.", "then refresh the page.", ", then refresh the page.", "to continue using this application.", "and reload the page", "to view this page", "to run this app."]
SCRIPTS = ["We use cookies and scripts on this page; allow both to view the report.", "This website uses cookies. Accept all cookies to continue.", "JavaScript is disabled in your browser. Turn it on and reload the page.", "Your browser does not support scripting, so the content cannot be displayed.", "<noscript>This page requires scripts. Activate them in your settings.</noscript>",
           "Loading... If nothing appears, make sure that scripts are allowed for {h}", "This site requires JavaScript to work.", "JavaScript is required.", "JavaScript must be enabled to use this page.", "This page needs JavaScript to display its content.", "It looks like JavaScript is turned off.",
           "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "JavaScript ist in Ihrem Browser deaktiviert. Diese Seite benötigt JavaScript.", "Veuillez activer JavaScript et les cookies pour afficher ce contenu.", "JavaScript est désactivé dans votre navigateur. Cette page nécessite JavaScript.",
           "Active JavaScript en su navegador para ver esta página.", "Por favor, habilite JavaScript para continuar. Esta página requiere JavaScript.", "Ative o JavaScript no seu navegador para ver esta página.", "Por favor, habilite o JavaScript para continuar. Esta página requer JavaScript.",
           "Включите JavaScript в браузере, чтобы просмотреть эту страницу.", "Для работы сайта необходимо включить JavaScript.", "请启用 JavaScript 以查看此页面。", "请在浏览器中启用 JavaScript 后刷新页面。", "您的浏览器未启用 JavaScript，无法显示内容。", "このページを表示するには JavaScript を有効にしてください。"]


# Short texts that say something, in words that residue uses too.
WRITTEN = ["Write a summary of the session", "Write a short description of the module for the manual", "Add a test for the component", "Add text search to the project", "Describe the root cause of the failure in the report", "Fix the name of the owner in the ticket",
           "Put the version in the title", "Enter the result in the table of runs", "The description of the error is wrong", "Show the status page in the summary", "Return the error code in the message", "Insert the date before the author"]


def exemplars() -> list[tuple[str, str]]:
    """(label, text) of every exemplar, some 2,000 by rule; the marks {x} {n} {i} {h} {p} stand for slot, number, id, host, path."""
    out = [("template", t) for t in TEMPLATES] + [("page", t) for t in PAGES] + [("scripts", t) for t in SCRIPTS] + [("filler", t) for t in STANDINS] + [("written", t) for t in WRITTEN]
    for name in NAMES:
        for verb in ("Enter", "Insert", "Put", "Type", "Write", "Add", "Provide", "Describe"):
            out += [("filler", f"{verb} {d} {name} {e}") for d, e in zip(("a short", "the", "your", "a"), ("(max. {n} characters)", "in this box", "here", "and press save"))]
            out += [("filler", f"{verb} {d} {name} {e}") for d, e in zip(("the", "your", "a short", "an"), ("and press save", "(max. {n} characters)", "in this box", "here"))]
        out += [("filler", f"{s} {name}") for s in STANDINS[:12]]
    out += [("filler", f"{s} {w}") for s in STANDINS[:10] for w in ("by {who}", "({who})", "{who}")]
    out += [("filler", f"{k} {t} {e}") for k in KINDS for t in THINGS for e in ("", ENDINGS[(len(k) + len(t)) % len(ENDINGS)])]
    out += [("filler", f"{t} {e}") for t in THINGS for e in ENDINGS]
    out += [("filler", f"{w} {w} {w}") for w in [*THINGS, "test", "bla", "blah", "foo", "none", "hello"]]
    out += [("page", f.format(n="{n}", s=s)) for f in STATUS_FORMS for s in STATUS]
    out += [("page", f"{n} {s}. {a}") for s in STATUS for a in AFTERMATH for n in ("{n}", "HTTP/1.1 {n}")] + [("page", a) for a in AFTERMATH]
    out += [("page", f"{s} {a}") for s in STATUS for a in STATUS_TAILS]
    out += [("scripts", o.format(a=a)) for o in SCRIPT_OPENINGS for a in SCRIPT_ACTIONS]
    out += [("scripts", f"{a} {e}") for a in SCRIPT_ACTIONS for e in SCRIPT_ENDINGS]
    out += [("scripts", f"{e} {f}") for e in SCRIPT_ENDINGS for f in SCRIPT_ENDINGS if e != f]
    return out
