"""Embedding providers over HTTP: batches of texts in, vectors out, with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from .requests import should_retry

#: Fixed values of the request format.
TIMEOUT_SECS, MAX_RETRIES, RETRY_DELAY_MS = 30, 5, 1_000

#: ``post(url, body, headers)`` gives status and response body; a transport failure raises ``OSError``.
Post = Callable[[str, bytes, dict[str, str]], tuple[int, bytes]]


def post_json(url: str, body: bytes, headers: dict[str, str]) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, headers)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_SECS) as response:
            return response.status, response.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


def http_provider(base_url: str, model: str, dims: int, api_key: str | None = None, max_retries: int = MAX_RETRIES, delay_ms: int = RETRY_DELAY_MS, post: Post = post_json) -> Callable[[list[str]], list[list[float]]]:
    """A provider for ``journal.embed_missing``: one call per batch to ``<base_url>/v1/embeddings``, vectors in input order.

    It runs inside tasks; a call that fails for good, or vectors of another number or size, fail the task.
    """
    url = f"{base_url.rstrip('/')}/v1/embeddings"
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})

    def embed(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"input": texts, "model": model}).encode()
        for attempt in range(1, max_retries + 2):
            status: int | None = None
            try:
                status, answer = post(url, body, headers)
                if status < 400:
                    break
                problem = f"status {status}"
            except OSError as error:
                problem = str(error)
            if not should_retry(attempt, max_retries + 1, status):
                raise RuntimeError(f"embedding failed after {attempt} attempts: {problem}")
            time.sleep(delay_ms / 1000)
        data = sorted(json.loads(answer)["data"], key=lambda d: d.get("index", 0))
        made = [d["embedding"] for d in data]
        if len(made) != len(texts) or any(len(v) != dims for v in made):
            raise ValueError(f"wanted {len(texts)} vectors of {dims} dimensions")
        return made

    return embed
