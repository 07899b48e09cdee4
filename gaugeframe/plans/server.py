"""The reports over HTTP, by the standard library: for a workbench beside a driver, not for the open internet.

GET /health; POST /analyze/hf with a JSON body (dataset, split, subset, text_col, label_col, max_rows, no_hf_models);
POST /analyze/csv with a form (file, text_col, label_col, no_hf_models). What the caller got wrong answers 400 with
{"detail": ...}. ``no_hf_models`` true takes the hashing and heuristic backends, else the ones given to ``serve``.
"""

from __future__ import annotations

import json
import os
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from gaugeframe.plans.api import analyze_csv_bytes, analyze_dataset

FIELDS = ("text_col", "label_col")


def form_of(kind: str, body: bytes) -> dict[str, Any]:
    """Fields of a multipart form; files as (name, bytes)."""
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
    if not message.is_multipart():
        raise ValueError("the body is no multipart form")
    out: dict[str, Any] = {}
    for part in message.iter_parts():
        name = part.get_param("name", header="content-disposition")
        data = part.get_payload(decode=True) or b""
        out[name] = (part.get_filename(), data) if part.get_filename() else data.decode("utf-8").strip()
    return out


def allowed_origins() -> tuple[str, ...]:
    named = tuple(x.strip() for x in os.environ.get("ALLOWED_ORIGINS", "").split(",") if x.strip())
    return named or ("http://localhost:3000", "http://127.0.0.1:3000")


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000, origins: tuple[str, ...] | None = None, **models: Any) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``; models: ``embedder`` and ``scorer``. origins None: those that the
    environment names in ALLOWED_ORIGINS, parted by commas, else a page on this machine's port 3000."""
    origins = allowed_origins() if origins is None else origins

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, payload: Any) -> None:
            data = json.dumps(payload, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self._cors()
            self.end_headers()
            self.wfile.write(data)

        def _cors(self) -> None:
            origin = self.headers.get("Origin")
            if origin and (origin in origins or "*" in origins):
                self.send_header("Access-Control-Allow-Origin", origin)
                self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
                self.send_header("Access-Control-Allow-Headers", "Content-Type")

        def do_OPTIONS(self) -> None:  # noqa: N802
            self.send_response(204)
            self._cors()
            self.end_headers()

        def do_GET(self) -> None:  # noqa: N802
            self._answer(200, {"status": "ok"}) if self.path == "/health" else self._answer(404, {"detail": "Not Found"})

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                if self.path == "/analyze/hf":
                    self._answer(200, self._dataset(json.loads(body or b"{}")))
                elif self.path == "/analyze/csv":
                    self._answer(200, self._upload(form_of(self.headers.get("Content-Type", ""), body)))
                else:
                    self._answer(404, {"detail": "Not Found"})
            except ValueError as e:
                self._answer(400, {"detail": str(e)})

        def _dataset(self, b: dict[str, Any]) -> dict[str, Any]:
            if not isinstance(b, dict) or not b.get("dataset"):
                raise ValueError("'dataset' is missing")
            chosen = {} if b.get("no_hf_models") else models
            return analyze_dataset(spark, str(b["dataset"]), b.get("split") or "train", b.get("subset"), *[b.get(k) for k in FIELDS], b.get("max_rows"), **chosen).data

        def _upload(self, f: dict[str, Any]) -> dict[str, Any]:
            if not isinstance(f.get("file"), tuple):
                raise ValueError("'file' is missing")
            chosen = {} if str(f.get("no_hf_models", "")).lower() in ("1", "true", "on", "yes") else models
            name, data = f["file"]
            return analyze_csv_bytes(spark, data, name, *[f.get(k) or None for k in FIELDS], **chosen).data

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
