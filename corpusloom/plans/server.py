"""The agent API over HTTP: JSON requests to Engine.route."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from .engine import Engine

#: Largest request body (fixed value).
MOST_BODY = 2 * 1024 * 1024


class AgentServer:
    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = 0):
        class Handler(BaseHTTPRequestHandler):
            def answer(self):
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST_BODY:
                    return self.send(413, {"error": "request body is too large"})
                url = urlsplit(self.path)
                try:
                    body = json.loads(self.rfile.read(size)) if size else {}
                    if not isinstance(body, dict):
                        raise ValueError("the body must be an object")
                    status, said = engine.route(url.path, body, self.command)
                except ValueError as error:
                    status, said = 400, {"error": str(error)}
                except Exception as error:
                    status, said = 500, {"error": str(error)[:500]}
                return self.send(status, said)

            do_GET = do_POST = answer

            def send(self, status, said):
                raw = json.dumps(said, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.thread: threading.Thread | None = None

    @property
    def port(self) -> int:
        return self.server.server_address[1]

    def start(self) -> AgentServer:
        self.thread = threading.Thread(target=self.server.serve_forever, daemon=True)
        self.thread.start()
        return self

    def status(self) -> dict:
        return {"running": self.thread is not None and self.thread.is_alive(), "port": self.port}

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()
