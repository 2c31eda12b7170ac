"""python -m terrafold plan|serve|goal|info|demo ..."""

from __future__ import annotations

import argparse
import json
import sys

from terrafold.config import Config

FLAGS = {
    "voxel": ("voxel_size", float), "robot-radius": ("robot_radius", float), "robot-height": ("robot_height", float), "max-slope": ("max_slope_deg", float),
    "max-step": ("max_step", float), "inflation": ("inflation_radius", float), "heuristic-weight": ("heuristic_weight", float), "snap-radius": ("snap_radius", float),
    "max-neighbors": ("max_neighbors", int), "alt": ("alt_landmarks", int), "cache-dir": ("cache_dir", str), "backend": ("search_backend", str),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrafold")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("plan", "serve", "info"):
        c = sub.add_parser(name)
        c.add_argument("map", help="a .pcd file, or demo")
        c.add_argument("--config")
        c.add_argument("--compat", action="store_true")
        c.add_argument("--bidirectional", action="store_true")
        c.add_argument("--no-collision-check", action="store_true")
        for flag, (_, kind) in FLAGS.items():
            c.add_argument(f"--{flag}", type=kind)
        c.add_argument("--viz")
        if name != "info":
            c.add_argument("--start", nargs=3, type=float, default=[2.0, 2.0, 0.0])
    plan, serve = sub.choices["plan"], sub.choices["serve"]
    plan.add_argument("--goal", nargs=3, type=float, required=True)
    plan.add_argument("--out", help="folder of CSV")
    plan.add_argument("--json", help="file")
    goal = sub.add_parser("goal")
    goal.add_argument("goal", nargs=3, type=float)
    goal.add_argument("--start", nargs=3, type=float)
    for c in (serve, goal):
        c.add_argument("--host", default="127.0.0.1")
        c.add_argument("--port", type=int, default=8765)
    demo = sub.add_parser("demo")
    demo.add_argument("out", help="folder of .pcd")
    return p


def config_of(args: argparse.Namespace) -> Config:
    """A file and --compat may be combined: the file's settings win over the preset's, flags over both."""
    base = Config.compat() if args.compat else Config()
    if args.config:
        import yaml

        with open(args.config, encoding="utf-8") as f:
            base = Config.from_dict(base.to_dict() | (yaml.safe_load(f) or {}))
    changes = {field: v for flag, (field, _) in FLAGS.items() if (v := getattr(args, flag.replace("-", "_"))) is not None}
    changes |= {"bidirectional": True} if args.bidirectional else {}
    return base.but(**changes | ({"edge_collision_check": False} if args.no_collision_check else {}))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "goal":
        from terrafold.serving import publish_goal

        out = publish_goal(*args.goal, host=args.host, port=args.port, start=args.start)
        print(json.dumps(out))
        return 0 if out.get("success") else 2
    from pyspark.sql import SparkSession

    from terrafold.plans.planner import TerrainMap, queries_frame
    from terrafold.session import ship
    from terrafold.sources import pcd, scene, sinks

    spark = SparkSession.builder.appName("terrafold").getOrCreate()
    ship(spark)
    if args.command == "demo":
        pcd.write(scene.scene(spark).select("x", "y", "z").coalesce(1), args.out)
        return 0
    cfg = config_of(args)
    terrain = TerrainMap.build(scene.scene(spark), cfg) if args.map in ("demo", "-") else TerrainMap.from_pcd(spark, args.map, cfg)
    if args.command == "info":
        print(json.dumps(terrain.stats(), indent=2))
    if args.command == "serve":
        from terrafold.serving import Service, server

        server(Service(spark, terrain, tuple(args.start), args.map), args.host, args.port).serve_forever()
    path = None
    if args.command == "plan":
        path, summary = terrain.make_plans(queries_frame(spark, [(tuple(args.start), tuple(args.goal))]))
        row = summary.first()
        print(json.dumps(row.asDict()))
        if not row["success"]:
            return 2
        if args.out:
            sinks.write_csv(path, args.out)
        if args.json:
            with open(args.json, "w", encoding="utf-8") as f:
                f.write(sinks.json_documents(path, summary).first()["document"])
    if args.viz:
        with open(args.viz, "w", encoding="utf-8") as f:
            f.write(sinks.html_page(sinks.scene_data(terrain.nodes, terrain.obstacles, cfg.lethal_cost, path, args.map)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
