"""A small planning service: the current pose, goals, plans; and its client.

Routes: GET /, /stats and /pose; POST /goal, /plan and /pose. A goal or pose is a JSON list [x, y, z] under its name, or the
members x, y and z (/plan wants the list); "start" may be given with a goal.
"""

from __future__ import annotations

import json
import threading
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import NamedTuple

from pyspark.sql import SparkSession

from terrafold.plans.planner import Plans, TerrainMap, queries_frame
from terrafold.sources import sinks


class Point(NamedTuple):
    x: float
    y: float
    z: float

    @classmethod
    def of(cls, value: object) -> Point:
        if not isinstance(value, list | tuple) or len(value) != 3:
            raise ValueError("a point is three numbers")
        return cls(*map(float, value))


@dataclass(frozen=True)
class Request:
    """What a body asks for: a point under ``name`` (or spread over x, y, z, if ``spread``), and a start."""

    point: Point
    start: Point | None = None

    @classmethod
    def read(cls, body: object, name: str, spread: bool = True) -> Request:
        if not isinstance(body, dict):
            raise ValueError("the body is a JSON object")
        value = body.get(name)
        if value is None and spread:
            value = [body[c] for c in Point._fields if c in body]
        start = body.get("start")
        return cls(Point.of(value), None if start is None else Point.of(start))


class Service:
    """Answers goals from the robot's pose; a reached goal becomes the pose. One request plans at a time."""

    def __init__(self, spark: SparkSession, terrain: TerrainMap, pose: tuple[float, float, float] = (0.0, 0.0, 0.0), name: str = "map") -> None:
        self.spark, self.terrain, self.pose, self.name = spark, terrain, Point.of(pose), name
        self.lock = threading.Lock()
        self.last: Plans | None = None
        self.routes: dict[tuple[str, str], Callable[[object], object]] = {
            ("GET", "/"): lambda _: self.page(),
            ("GET", "/index.html"): lambda _: self.page(),
            ("GET", "/stats"): lambda _: self.terrain.stats(),
            ("GET", "/pose"): lambda _: {"pose": [*self.pose]},
            ("POST", "/goal"): lambda body: self.goal(Request.read(body, "goal")),
            ("POST", "/plan"): lambda body: self.goal(Request.read(body, "goal", spread=False)),
            ("POST", "/pose"): lambda body: self.move(Request.read(body, "pose")),
        }

    def move(self, request: Request) -> dict:
        with self.lock:
            self.pose = request.point
            return {"ok": True, "pose": [*self.pose]}

    def goal(self, request: Request) -> dict:
        with self.lock:
            plans = self.terrain.make_plans(queries_frame(self.spark, [(request.start or self.pose, request.point)]))
            out = json.loads(sinks.payloads(*plans).first()["payload"])
            # tables of plans that nothing shows any more go
            old = plans
            if out["success"]:
                old, self.last = self.last, plans
                self.pose = Point(*(out["path"][c][-1] for c in Point._fields))
            if old is not None:
                old.drop()
            return out

    def page(self) -> str:
        t = self.terrain
        with self.lock:
            return sinks.html_page(sinks.scene_data(t.nodes, t.obstacles, t.config.lethal_cost, self.last and self.last[0], self.name), live=True)

    def answer(self, method: str, path: str, body: object) -> tuple[int, object]:
        """Status and content. A wrong request is told to its sender with 400."""
        route = self.routes.get((method, path))
        if route is None:
            return 404, {"error": "not found"}
        try:
            return 200, route(body)
        except Exception as e:  # noqa: BLE001
            return 400, {"success": False, "message": f"{type(e).__name__}: {e}"}


def server(service: Service, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def handled(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                code, out = service.answer(self.command, self.path, json.loads(raw) if raw else {})
            except ValueError as e:
                code, out = 400, {"success": False, "message": f"not JSON: {e}"}
            self.reply(code, out, {} if isinstance(out, str) else {"Content-Type": "application/json"})

        def reply(self, code: int, out: object, headers: dict[str, str]) -> None:
            data = b"" if out is None else out.encode() if isinstance(out, str) else json.dumps(out).encode()
            self.send_response(code)
            for name, value in ({"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(data)), "Access-Control-Allow-Origin": "*"} | headers).items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def preflight(self) -> None:
            self.reply(204, None, {"Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type"})

        do_GET = do_POST = handled
        do_OPTIONS = preflight

        def log_message(self, *_: object) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)


def ask(path: str, body: dict | None = None, host: str = "127.0.0.1", port: int = 8765, timeout: float = 300.0) -> dict:
    """What a service answers to ``body`` (without one, to a GET); errors of the service come back as its messages."""
    data = None if body is None else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://{host}:{port}{path}", data), timeout=timeout) as r:
            return json.load(r)
    except urllib.request.HTTPError as e:
        return json.load(e)


def publish_goal(x: float, y: float, z: float, host: str = "127.0.0.1", port: int = 8765, start: list[float] | None = None) -> dict:
    return ask("/goal", {"goal": Point(x, y, z)} | ({} if start is None else {"start": Point.of(start)}), host, port)
