"""Labelled examples for the clause tagger: about 500 short pairs, made of the clauses below."""

from __future__ import annotations

# Labelled clauses of each language.
GOALS = {
    "en": ["Explain why the import of load_batch fails on windows", "Fix the flaky test_open_cache and keep the patch small", "Write a summary of the session"],
    "de": ["Behebe den Fehler in test_open_cache, der nach dem Neustart auftritt", "Warum verliert load_batch beim Lauf 20 Zeilen?"],
    "fr": ["Corrige l'erreur de test_open_cache qui apparaît après le redémarrage", "Pourquoi load_batch perd-il 20 lignes pendant la nuit ?"],
    "es": ["Corrige el error de test_open_cache que aparece después del reinicio", "¿Por qué load_batch pierde 20 filas por la noche?"],
    "pt": ["Corrija o erro de test_open_cache que aparece depois do reinício", "Por que load_batch perde 20 linhas durante a noite?"],
    "ru": ["Исправь ошибку в test_open_cache, которая появляется после перезапуска", "Почему load_batch теряет 20 строк ночью?"],
    "zh": ["请修复 test_open_cache 在重启之后出现的错误", "为什么 load_batch 在夜间丢失 20 行数据？"],
}
ANSWERS = {
    "en": ["I changed read_index in src/store.py so that the file is closed first.", "The check passes now in 120 ms.", "I can't reproduce the error any more after the change.",
           "Sorry about the noise in the log.", "The server refused the connection, so I pinned the port.", "load_batch cannot help callers here because its queue is full.",
           "As an assistant table, queue_map declines old rows.", "I was unable to keep the old name.", "The old value came from version 2.1 and was never intended.", "I'm sorry for the long diff.",
           "Nothing else depends on it.", "The policy file is read once.", "The log line read “Die Ursache war der Wert, weil er zu früh gelesen wurde.”."],
    "de": ["Ich habe read_index so geändert, dass die Datei zuerst geschlossen wird.", "Der Test läuft jetzt durch und bleibt grün.", "Der Fehler lässt sich nach der Änderung nicht mehr auslösen."],
    "fr": ["J'ai modifié read_index afin que le fichier soit fermé avant le démarrage.", "La cause venait de la valeur lue trop tôt.", "Le test passe maintenant et reste stable."],
    "es": ["He cambiado read_index para que el archivo se cierre antes del arranque.", "La prueba ahora termina y sigue estable.", "La causa estaba en el valor que se leía demasiado pronto."],
    "pt": ["Alterei read_index para que o arquivo seja fechado antes do início.", "O teste agora termina e continua estável.", "A causa estava no valor que era lido cedo demais."],
    "ru": ["Я изменил read_index, чтобы файл закрывался до запуска.", "Тест теперь проходит и остаётся стабильным.", "Причина была в том, что значение читалось слишком рано."],
    "zh": ["我修改了 read_index，让文件在启动之前关闭。", "测试现在通过，第二次运行也保持稳定。", "原因在于这个值读取得太早。"],
}
REFUSALS = {
    "en": ["I can't help with that.", "I'm sorry, but I cannot assist with this request.", "Unfortunately, I won't be able to complete this task.", "As an AI assistant I am not able to edit files.",
           "I must decline: this goes against my guidelines.", "My policy does not permit me to touch src/store.py.", "No. I will not carry out this instruction.", "I am unable to provide an answer about this.",
           "Sorry, I don't have access to your repository, so I can't do this.", "I refuse to do this.", "I have to decline this request.", "I'm not able to comply with this instruction.", "I am not allowed to do that.",
           "That is outside of what I'm allowed to do, even for load_batch.", "I'd prefer not to work on load_batch.", "I don't feel comfortable doing that, and I hope you understand.",
           "It would be inappropriate for me to change load_batch, so I'll stop here.", "Regrettably this is something I have to leave to a human, so no changes were made.",
           "This falls beyond my capabilities as a language model; try asking your team."],
    "de": ["Es tut mir leid, aber dabei kann ich nicht helfen.", "Leider kann ich diese Anfrage nicht bearbeiten.", "Als KI-Assistent kann ich keine Dateien ändern und nicht helfen.", "Ich muss das ablehnen.", "Ich bin nicht befugt, das zu beantworten."],
    "fr": ["Je suis désolé, mais je ne peux pas vous aider pour cette demande.", "En tant qu'assistant, je ne peux pas modifier de fichiers.", "Je dois refuser cette demande.", "Je ne suis pas en mesure de répondre à cette question."],
    "es": ["Lo siento, pero no puedo ayudar con esta solicitud.", "Como asistente no puedo modificar archivos.", "Debo negarme a esta tarea.", "No estoy autorizado a responder a eso."],
    "pt": ["Desculpe, mas não posso ajudar com este pedido.", "Como assistente não posso alterar arquivos.", "Infelizmente não consigo fazer esta tarefa.", "Não estou autorizado a responder a isso."],
    "ru": ["Извините, я не могу помочь с этим запросом.", "К сожалению, я не могу выполнить этот запрос.", "Как ассистент я не могу изменять файлы.", "Я не могу ответить на этот вопрос."],
    "zh": ["抱歉，我无法协助完成这个请求。", "作为助手，我不能修改文件。", "很遗憾，我无法帮助你。", "我不能回答这个问题。"],
}
UNFINISHED = {
    "en": ["The cause was the value that", "Finally,", "You can confirm this with the", "I changed read_index in src/store.py so that it closes", "All 20 tests pass on linux, and the working", "The test in", "All 20 tests", "I changed read_index", "No other caller"],
    "de": ["Auf dem langsamen Rechner dauert der", "Bitte prüft vor der Freigabe,", "Die Ursache war der Wert, weil"],
    "fr": ["La cause venait de la", "Le test passe maintenant en", "J'ai modifié read_index afin que le fichier"],
    "es": ["La causa estaba en el", "Antes de publicar, revisad si", "La prueba ahora termina en"],
    "pt": ["A causa estava no", "O teste agora termina em", "Alterei read_index para que o arquivo"],
    "ru": ["Прежнее поведение осталось от версии", "Я изменил read_index, чтобы", "Тест теперь проходит за"],
    "zh": ["我修改了 read_index，让文件在启动", "测试现在通过，第二次运行也", "原因在于这个值读取得"],
}
TAILS = ["- src/store.py", "Exit code 0", "See https://example.org/runs/a", "```\nreturn row\n```", "./run_cache.sh --limit 20", "2. test_open_cache", "cache = Client(KEY)"]
OPENINGS = ["Hello!", "Thanks for the context on load_batch.", "I looked at src/store.py briefly.", "No."]
LABELS = ["{}", "Task: {}", '"{}"', "**{}**"]
ASKS = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "pt": "Portuguese", "ru": "Russian", "zh": "Chinese"}


def labelled() -> list[tuple[str, str, list[str]]]:
    """(goal, answer, tag of each clause), the clauses combined by rule; the same on every call."""
    rows: list[tuple[str, str, list[str]]] = []
    for lang, goals in GOALS.items():
        for g, goal in enumerate(goals):
            said = ANSWERS[lang]
            for k, text in enumerate(said):
                two = said[(k + 1) % len(said)]
                rows.append((goal, f"{text} {two}", ["answer", "answer"]))
                rows.append((goal, f"{text}\n{TAILS[(k + g) % len(TAILS)]}", ["answer", "answer"]))
                rows.append((f"{goal} (reply in {ASKS['fr']})", f"{text} {ANSWERS['fr'][k % 3]}", ["answer", "answer"]))
            for k, text in enumerate(REFUSALS[lang]):
                if text.startswith("No. "):
                    rows.append((goal, text, ["answer", "refusal"]))
                    continue
                rows.append((goal, text, ["refusal"]))
                rows.append((goal, f"{text} {said[k % len(said)]}", ["refusal", "answer"]))
            if lang == "en":
                for k, text in enumerate(REFUSALS[lang]):
                    if "No. " not in text:
                        rows.append((goal, f"{OPENINGS[k % len(OPENINGS)]} {text}", ["answer", "refusal"]))
                        rows.append((goal, f"{OPENINGS[k % len(OPENINGS)]} {text} {REFUSALS[lang][k % 3]}", ["answer", "refusal", "refusal"]))
            for k, text in enumerate(UNFINISHED[lang]):
                rows.append((goal, f"{said[k % len(said)]} {text}", ["answer", "unfinished"]))
                if len(text.split()) > 3 or text.endswith(","):
                    rows.append((goal, text, ["unfinished"]))
            plain = goal.rstrip("?？").strip().lstrip("¿")
            for k, label in enumerate(LABELS):
                rows.append((goal, label.format(plain), ["echo"]))
                rows.append((goal, f"{label.format(plain)}. {said[k % len(said)]}", ["echo", "answer"]))
            for other, texts in ANSWERS.items():
                if other != lang:
                    rows.append((goal, f"{texts[0]} {texts[1]}", ["foreign", "foreign"]))
                    rows.append((goal, f"OK. {texts[2]}", ["answer", "foreign"]))
                    rows.append((goal, f"{texts[1]} {texts[2]} {texts[0]}\n{TAILS[g]}", ["foreign", "foreign", "foreign", "answer"]))
                    rows.append((goal, f"{texts[0]} {said[0]} {said[1]}", ["foreign", "answer", "answer"]))
                    rows.append((f"{goal} (reply in {ASKS[other]})", f"{texts[0]} {texts[1]}", ["answer", "answer"]))
            rows.append((goal, f"{said[1]}\n1. test_open_cache\n2. Finally,", ["answer", "answer", "unfinished"]))
            rows.append((goal, f"{said[1]} {said[2]}\n```sh\nread_index --limit", ["answer", "answer", "unfinished"]))
            rows.append((goal, f"{said[0]}\n```python\ndef read_index(row):\n    if row", ["answer", "unfinished"]))
    return rows
