"""Other services behind small interfaces: requests with retries, a cache, a chat client. Offline use passes a stub."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Send = Callable[[str, bytes | None, dict], tuple[int, bytes]]


class ServiceError(RuntimeError):
    pass


def send(url: str, body: bytes | None, headers: dict, timeout: float = 60) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def request(url: str, body: bytes | None = None, headers: dict | None = None, retries: int = 3, backoff: float = 1.0, send: Send = send, sleep=time.sleep) -> bytes | None:
    """The reply; None for 404. Timeouts, lost connections and 5xx are tried again, a little later each time; other 4xx are errors at once."""
    why = ""
    for k in range(retries + 1):
        try:
            status, data = send(url, body, headers or {})
        except (OSError, TimeoutError) as e:
            why = str(e)
        else:
            if status == 404:
                return None
            if status < 400:
                return data
            if status < 500:
                raise ServiceError(f"{url}: {status}")
            why = f"{url}: {status}"
        if k < retries:
            sleep(backoff * (k + 1))
    raise ServiceError(why)


def post_file(url: str, name: str, content: bytes, fields: dict[str, str] | None = None, kind: str = "application/pdf", **how) -> bytes:
    """The reply to a form with fields and a file named ``input``, as parsers take documents; ``how`` goes to request()."""
    mark = uuid.uuid4().hex.encode()
    head = lambda rest: b"--" + mark + b'\r\nContent-Disposition: form-data; name="' + rest + b"\r\n"
    parts = [head(f'{k}"\r\n'.encode()) + str(v).encode() + b"\r\n" for k, v in (fields or {}).items()]
    safe = name.replace('"', "%22").replace("\r", "").replace("\n", "")
    parts.append(head(f'input"; filename="{safe}"\r\nContent-Type: {kind}\r\n'.encode()) + content + b"\r\n")
    data = request(url, b"".join(parts) + b"--" + mark + b"--\r\n", {"Content-Type": f"multipart/form-data; boundary={mark.decode()}"}, **how)
    if data is None:
        raise ServiceError(f"{url}: 404")
    return data


def worth_keeping(fetched: DataFrame) -> DataFrame:
    """key, body to be cached: what came, and what the service says it hasn't (a null body); other failures are asked for again."""
    return fetched.where("error IS NULL OR error = 'not found'").select("key", "body")


def fetch_missing(keys: DataFrame, cached: DataFrame, fetch: Callable[..., bytes | None], payload: str | None = None) -> DataFrame:
    """key, body, error of every key: cached ones first (a null body is one not found); the others are fetched in the tasks, a failure kept with its row.

    keys: key and, if named, a payload that is fetch's second argument (a file's content); cached: key, body.
    """
    known = keys.join(cached.select("key", "body", F.lit(True).alias("hit")), "key", "left")
    extra = [payload] if payload else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies, errors = [], []
            for args in zip(*(frame[c] for c in ["key", *extra])):
                try:
                    data = fetch(*args)
                    bodies.append(None if data is None else data.decode("utf-8", "replace"))
                    errors.append("not found" if data is None else None)
                except Exception as e:  # one failure must not end the job
                    bodies.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"key": frame["key"], "body": bodies, "error": errors})

    new = known.where("hit IS NULL").select("key", *extra).mapInPandas(run, "key string, body string, error string")
    return known.where("hit").select("key", "body", F.when(F.col("body").isNull(), "not found").alias("error")).unionByName(new)


@dataclass(frozen=True)
class Completion:
    text: str
    model: str
    finish_reason: str | None


class ChatClient:
    """An OpenAI-style chat service."""

    def __init__(self, url: str, model: str, key: str | None = None, retries: int = 3, backoff: float = 1.0, send: Send = send):
        self.url, self.model, self.key, self.retries, self.backoff, self.send = url.rstrip("/"), model, key, retries, backoff, send

    def complete(self, messages: list[dict], temperature: float = 0.0, max_tokens: int = 512) -> Completion:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        data = request(f"{self.url}/chat/completions", body, headers, self.retries, self.backoff, self.send)
        try:
            reply = json.loads(data or b"")
            first = reply["choices"][0]
            text, why = first["message"]["content"] or "", first.get("finish_reason")
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise ServiceError("malformed completion") from e
        if not text and why == "length":
            raise ServiceError("empty completion at the length limit")
        return Completion(text, reply.get("model", self.model), why)


def prompt(question: str, context: str) -> list[dict]:
    system = "Answer from the numbered sources only and cite them as [n]. If they do not hold the answer, reply NO_ANSWER_IN_CONTEXT: and why."
    return [{"role": "system", "content": system}, {"role": "user", "content": f"Question: {question}\n\nSources:\n\n{context}"}]


def generate(contexts: DataFrame, client: ChatClient) -> DataFrame:
    """qid, reply, error, seconds. contexts: qid, question, context; a failed call is its row's error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for qid, question, context in zip(frame["qid"], frame["question"], frame["context"]):
                began = time.perf_counter()
                try:
                    out.append((qid, client.complete(prompt(question, context)).text, None, time.perf_counter() - began))
                except ServiceError as e:
                    out.append((qid, None, str(e), time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["qid", "reply", "error", "seconds"])

    return contexts.select("qid", "question", "context").mapInPandas(run, "qid string, reply string, error string, seconds double")
