"""Stand-ins for models, chat services and parsers, with answers a SQL statement can repeat.

They run in Python tasks, so they are plain functions built by factories.
"""

from __future__ import annotations

import json


def word_count_model():
    def predict(images, questions):
        return [f" Yes. {image} has {len(question)} letters." for image, question in zip(images, questions)]

    return predict


def echo_chat():
    """Fails for every seventh text length, whatever the number of retries."""

    def client(messages, model):
        content = messages[-1]["content"]
        if len(content) % 7 == 0:
            raise RuntimeError("unavailable")
        return f"{model} got {len(messages)} messages, {len(content)} letters"

    return client


def interviewer(turns: int):
    """Asks ``key % turns`` questions about the sample, then ends."""

    def make():
        def client(messages, model):
            key = json.loads(messages[1]["content"])["c_custkey"]
            asked = (len(messages) - 2) // 2
            return "END" if asked >= key % turns else f"Question {asked + 1} about {key}?"

        return client

    return make


def interviewed():
    def predict(images, questions):
        return [f"Yes. {image}: {question} Fine." for image, question in zip(images, questions)]

    return predict


def length_grader():
    """One fenced grading per answer; answers of every eleventh length get no JSON."""

    def client(messages, model):
        answer = messages[1]["content"].split("\x1f", 1)[1]
        if len(answer) % 11 == 0:
            return "I would rather not say."
        rows = [{"sentence": f"{len(answer)} letters", "result_type": str(len(answer) % 3), "reason": model}]
        return "Here you are:\n```json\n" + json.dumps(rows) + "\n```"

    return client


def long_word_annotator():
    """Every word is a token of its own tree; words of four letters and more are chunks."""

    def parse(text):
        tokens, chunks = [], []
        for i, word in enumerate(text.lower().split(" ")):
            noun = len(word) > 3
            tokens.append(dict(i=i, text=word, lemma=word, pos="NOUN" if noun else "X", dep="ROOT", head_i=i, ws=True))
            if noun:
                chunks.append(dict(chunk_id=len(chunks), start=i, end=i + 1, root_i=i, text=word, lemma=word))
        return tokens, chunks

    return parse
