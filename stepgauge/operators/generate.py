"""Generation: any callable that answers prompts, retries, histories, repairs.

Jobs are spread over the executors; within a job answers depend on those
before, so one call works through one exercise.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from stepgauge.sources import trees
from stepgauge.sources.config import filled

#: (model, prompt) to an answer; what goes wrong is a RuntimeError.
Generator = Callable[[str, str], str]


def http_generator(endpoint: str, timeout: float = 600, temperature: float = 0.0, num_predict: int | None = None, empty_is_error: bool = True) -> Generator:
    """A generator behind a local HTTP service that takes and gives JSON."""
    def generate(model: str, prompt: str) -> str:
        options = {"temperature": temperature} | ({"num_predict": num_predict} if num_predict else {})
        body = json.dumps({"model": model, "prompt": prompt, "stream": False, "options": options}).encode()
        request = urllib.request.Request(endpoint, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
                answer = str(json.loads(reply.read()).get("response", ""))
        except (OSError, ValueError) as wrong:
            raise RuntimeError(f"the generator at {endpoint} failed: {wrong}") from wrong
        if empty_is_error and not answer.strip():
            raise RuntimeError(f"{model} gave an empty answer")
        return answer

    return generate


def retried(generate: Generator, attempts: int = 1, delay: float = 0.0) -> Generator:
    """A generator that tries again, a fixed time later."""
    def again(model: str, prompt: str) -> str:
        for n in range(attempts):
            try:
                return generate(model, prompt)
            except RuntimeError:
                if n + 1 == attempts:
                    raise
                time.sleep(delay)
        raise ValueError("at least one attempt is needed")

    return again


def question_prompt(exercise: dict, number: int, strategy: str, own: list[str], prompts: dict) -> str:
    """The prompt for one question of an exercise row; own: the answers given so far."""
    empty, labels = prompts.get("empty_value", "none"), prompts.get("labels") or {}
    listed = lambda xs: "\n".join(f"- {x}" for x in xs) if len(xs) else empty
    subs = list(exercise["subquestions"])
    asked = lambda n: f"{labels.get('question', 'Question')} {n}:\n{subs[n - 1]['question']}"

    def history(answers: list[str | None], label: str) -> str:
        return "\n\n".join(f"{asked(n)}\n\n{label}:\n{a}" for n, a in enumerate(answers, 1)) or empty

    values = {"accumulated_questions": "", "ground_truth_history": "", "self_history": ""}
    if strategy == "prompt_accumulation":
        values["accumulated_questions"] = "\n\n".join(map(asked, range(1, number + 1)))
    elif strategy == "ground_truth_forcing":
        exact = [s["answer"] for s in subs[: number - 1]]
        if missing := [n for n, a in enumerate(exact, 1) if not a]:
            raise RuntimeError(f"no reference answer for question {missing[0]}")
        values["ground_truth_history"] = history(exact, labels.get("exact_solution", "Exact solution"))
    elif strategy == "self_history":
        values["self_history"] = history(list(own), labels.get("your_answer", "Your answer"))
    sub = subs[number - 1]
    values |= {"context": exercise["context"] or empty, "global_assumptions": listed(exercise["assumption_global"]), "current_assumptions": listed(sub["assumptions"]), "current_question_number": str(number), "current_question": sub["question"]}
    return f"{filled(prompts['common_header'], values).strip()}\n\n{filled(prompts['strategies'][strategy], values).strip()}".strip()


def answers(jobs: DataFrame, generate: Generator, prompts: dict[str, dict]) -> DataFrame:
    """An answer to each question of jobs(pc, q, language, variation, model, strategy, context, assumption_global, subquestions).

    A job whose generator fails for good has one row with its error and no answer.
    """
    keys = ["pc", "q", "model", "language", "variation", "strategy", *(["mode"] if "mode" in jobs.columns else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for job in batch.to_dict("records"):
                key, own = [job[k] for k in keys], []
                try:
                    for n, sub in enumerate(job["subquestions"], 1):
                        own.append(generate(job["model"], question_prompt(job, n, job["strategy"], own, prompts[job["language"]])))
                    out += [(*key, n, sub["question"], a, None) for n, (sub, a) in enumerate(zip(job["subquestions"], own, strict=True), 1)]
                except RuntimeError as wrong:
                    out.append((*key, None, None, None, str(wrong)))
            yield pd.DataFrame(out, columns=[*keys, "subquestion", "question", "answer", "error"]).astype({"subquestion": "Int32"})

    return jobs.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", subquestion int, question string, answer string, error string")


def read_single(response: str) -> tuple[object, str | None]:
    """(atoms, None) of a response to one question, or (None, its first fault)."""
    data, wrong = trees.first_mapping(tidy(response))
    return (None, wrong) if data is None else trees.single_question(trees.repaired(data))


def tidy(response: str) -> str:
    """In Python what functions.text.repaired_yaml(fenced(..)) does on columns, for use between two calls of a generator."""
    import re

    from stepgauge.functions import text as T

    text = T.THINKING.text(response).strip()
    for pattern in (r"(?is)```(?:yaml|yml)\s*(.*?)```", r"(?s)```\s*(.*?)```", r"(?is)```(?:yaml|yml)?\s*(.*)"):
        if found := re.search(pattern, text):
            text = found[1].strip()
            break
    lines = []
    for line in re.sub("!+python/tuple", "!!python/tuple", text).splitlines():
        if (m := re.match(r'^(\s*-\s+)"(.*)"(\s*)$', line)) and "\\" in m[2]:
            line = m[1] + "'" + m[2].replace("'", "''") + "'" + m[3]
        if (m := re.match(r"^(\s*-\s+)(\{.*|\*\*.*)$", line)) and not re.match(r"^\{\s*['\"]?[\w-]+['\"]?\s*:", m[2]):
            line = m[1] + '"' + m[2].replace("\\", "\\\\").replace('"', '\\"') + '"'
        lines.append(line)
    return "\n".join(lines)


def conversion(model: str, block: str, values: dict[str, str], generate: Generator, prompts: dict, repairs: int) -> tuple[object, str | None, str]:
    """(atoms, fault, last response) of one block, asked to be repaired up to ``repairs`` times."""
    task = filled(prompts["per_question_conversion"], values | {"source_answer": block})
    response = generate(model, task)
    atoms, fault = read_single(response)
    for _ in range(repairs):
        if atoms is not None:
            break
        response = generate(model, filled(prompts["repair"], {"raw_response": f"Original task:\n{task}\n\nInvalid response:\n{response}", "error_message": fault or "unknown error"}))
        atoms, fault = read_single(response)
    return atoms, fault, response


def conversions(jobs: DataFrame, generate: Generator, prompts: dict[str, dict], repairs: int = 2) -> DataFrame:
    """A conversion of each answer of jobs(.., model, blocks): its YAML, or the fault of its first bad block."""
    keys = [c for c in jobs.columns if c not in ("model", "blocks", "text")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for job in batch.to_dict("records"):
                subs, raw, error = [], [], None
                head = {k: str(job[k]) for k in keys}
                for n, block in enumerate(job["blocks"], 1):
                    try:
                        atoms, fault, response = conversion(job["model"], block, head | {"question_block_index": str(n), "question_block_count": str(len(job["blocks"]))}, generate, prompts[job["language"]], repairs)
                    except (RuntimeError, TimeoutError) as wrong:
                        atoms, fault, response = None, str(wrong), ""
                    raw.append(f"### Question block {n}\n{response}")
                    if atoms is None:
                        error = f"Question block {n}/{len(job['blocks'])} failed: {fault}"
                        break
                    subs.append({"atoms": atoms})
                text = None if error else trees.dumped(head | {"call2_model": job["model"], "subquestions": subs})
                out.append((*[job[k] for k in keys], job["model"], text, "\n\n".join(raw), error))
            yield pd.DataFrame(out, columns=[*keys, "call2_model", "text", "raw_response", "error"])

    kinds = dict(jobs.dtypes)
    return jobs.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", call2_model string, text string, raw_response string, error string")


def direct_yaml(answers: list[str]) -> tuple[str | None, str | None]:
    """(YAML, None) of an exercise whose answers are YAML already, or (None, the first fault)."""
    subs = []
    for n, answer in enumerate(answers, 1):
        atoms, fault = read_single(answer)
        if atoms is None:
            return None, f"answer {n}: {fault}"
        subs.append({"atoms": atoms})
    return trees.dumped({"subquestions": subs}), None

