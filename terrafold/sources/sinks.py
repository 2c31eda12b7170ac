"""Paths as CSV text, JSON documents and response payloads, and a map as a scene for the browser."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geometry import cost_rgb


def csv_lines(path: DataFrame) -> DataFrame:
    """query_id, seq, line: x,y,z,yaw with six decimals."""
    return path.select("query_id", "seq", F.format_string("%.6f,%.6f,%.6f,%.6f", "x", "y", "z", "yaw").alias("line"))


def write_csv(path: DataFrame, folder: str) -> None:
    """A folder of CSV with a header for each query id."""
    six = [F.format_string("%.6f", c).alias(c) for c in ("x", "y", "z", "yaw")]
    path.select("query_id", "seq", *six).repartition("query_id").sortWithinPartitions("query_id", "seq").drop("seq").write.mode("overwrite").option("header", True).partitionBy("query_id").csv(folder)


def _column(name: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct("seq", F.bround(name, 4).alias("v"))))
    return F.transform(ordered, lambda r: r["v"]).alias(name)


def payloads(path: DataFrame, summary: DataFrame) -> DataFrame:
    """query_id, payload: what a service answers, columns of coordinates with four decimals (half to even)."""
    cols = path.groupBy("query_id").agg(*(_column(c) for c in ("x", "y", "z", "yaw")))
    none = F.array().cast("array<double>")
    shape = F.struct(*(F.coalesce(c, none).alias(c) for c in ("x", "y", "z", "yaw")))
    cost = F.when(F.col("cost") < float("inf"), F.col("cost"))
    df = summary.join(cols, "query_id", "left")
    took = [F.round("planning_time", 4).alias("planning_time")] if "planning_time" in summary.columns else []
    return df.select("query_id", F.to_json(F.struct("success", "message", "length", "climb", cost.alias("cost"), "expanded", *took, shape.alias("path")), {"ignoreNullFields": "false"}).alias("payload"))


def json_documents(path: DataFrame, summary: DataFrame) -> DataFrame:
    """query_id, document: the summary with a list of poses."""
    poses = path.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "z", "yaw"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["yaw"].alias("yaw"))).alias("poses"))
    return summary.join(poses, "query_id", "left").select("query_id", F.to_json(F.struct("success", "message", "length", "climb", "cost", "expanded", *(c for c in ("planning_time",) if c in summary.columns), "poses")).alias("document"))


def sampled(df: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of their key."""
    return df.orderBy(F.sha1(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(limit)


def scene_data(nodes: DataFrame, obstacles: DataFrame, lethal_cost: float, path: DataFrame | None = None, name: str = "map", limit: int = 60_000) -> dict:
    """Sampled positions and colours as base64, the box around them, and a path."""
    import numpy as np

    n = sampled(nodes, "node_id", limit).select("x", "y", "z", cost_rgb(F.col("cost").cast("double"), F.col("lethal"), lethal_cost).alias("c")).select("x", "y", "z", "c.*").toPandas()
    o = sampled(obstacles, "obst_id", limit, 1).select("x", "y", "z").toPandas()
    pos = np.vstack([n[["x", "y", "z"]].to_numpy(), o.to_numpy()]).astype("f4")
    col = np.vstack([n[["r", "g", "b"]].to_numpy(), np.tile([110, 118, 132], (len(o), 1))]).astype("u1")
    text = lambda a: base64.b64encode(np.ascontiguousarray(a).tobytes()).decode()
    lo, hi = pos.min(axis=0), pos.max(axis=0)
    out = {"map_name": name, "n_ground": len(n), "n_total": len(pos), "pos": text(pos), "col": text(col), "bbox": [lo.tolist(), hi.tolist()], "center": pos.mean(axis=0).tolist(), "extent": float(np.linalg.norm(hi - lo)), "path": None}
    if path is not None:
        p = path.orderBy("query_id", "seq").select("x", "y", "z").toPandas().to_numpy().astype("f4")
        out |= {"path": text(p), "n_path": len(p)}
    return out


_PAGE = """<!doctype html><meta charset="utf-8"><title>%(title)s</title>
<style>body{margin:0;background:#14171c;color:#dde;font:14px sans-serif}canvas{display:block;width:100vw;height:100vh}#t{position:fixed;left:1em;top:1em}</style>
<div id="t">%(title)s</div><canvas id="c"></canvas><script>
const S=%(data)s, bytes=s=>Uint8Array.from(atob(s),c=>c.charCodeAt(0)), floats=s=>new Float32Array(bytes(s).buffer);
const P=floats(S.pos), C=bytes(S.col), cv=document.getElementById('c'), g=cv.getContext('2d');
let L=S.path?[...floats(S.path)]:[], yaw=.7, tilt=.9, zoom=1, from=null;
function at(x,y,z,w,h){x-=S.center[0];y-=S.center[1];z-=S.center[2];const a=Math.cos(yaw)*x-Math.sin(yaw)*y,b=Math.sin(yaw)*x+Math.cos(yaw)*y,k=zoom*.9*Math.min(w,h)/S.extent;return[w/2+a*k,h/2-(b*Math.cos(tilt)+z*Math.sin(tilt))*k]}
function draw(){const w=cv.width=innerWidth,h=cv.height=innerHeight;for(let i=0;i<S.n_total;i++){const[a,b]=at(P[3*i],P[3*i+1],P[3*i+2],w,h);g.fillStyle=`rgb(${C[3*i]},${C[3*i+1]},${C[3*i+2]})`;g.fillRect(a,b,2,2)}
if(L.length){g.strokeStyle='#4df';g.lineWidth=3;g.beginPath();for(let i=0;i<L.length;i+=3){const q=at(L[i],L[i+1],L[i+2]+.1,w,h);i?g.lineTo(...q):g.moveTo(...q)}g.stroke()}}
// a click takes the nearest shown ground point as goal (with Shift: as start) and asks the service for a plan
let start=null;const tell=t=>document.getElementById('t').textContent=t;
function picked(e){let best=-1,least=400;for(let i=0;i<S.n_ground;i++){const[a,b]=at(P[3*i],P[3*i+1],P[3*i+2],cv.width,cv.height),d=(a-e.x)**2+(b-e.y)**2;if(d<least){least=d;best=i}}return best<0?null:[P[3*best],P[3*best+1],P[3*best+2]]}
async function ask(e){const p=picked(e);if(!p)return;if(e.shiftKey){start=p;return tell('start '+p.map(v=>v.toFixed(2)))}
const r=await(await fetch('/goal',{method:'POST',body:JSON.stringify(start?{goal:p,start}:{goal:p})})).json();tell(r.success?`length ${r.length.toFixed(2)} m`:r.message);
if(r.success){L=[];r.path.x.forEach((x,i)=>L.push(x,r.path.y[i],r.path.z[i]));g.clearRect(0,0,cv.width,cv.height);draw()}}
let down=null;cv.onmousedown=e=>{from=down=[e.x,e.y]};cv.onclick=e=>{if(S.live&&Math.hypot(e.x-down[0],e.y-down[1])<4)ask(e)};onmouseup=()=>from=null;onmousemove=e=>{if(from){yaw+=(e.x-from[0])/200;tilt+=(e.y-from[1])/200;from=[e.x,e.y];draw()}};
cv.onwheel=e=>{zoom*=e.deltaY<0?1.1:.9;draw()};onresize=draw;draw();</script>"""


def html_page(scene: dict, live: bool = False) -> str:
    """A page of its own, without outside parts; ``live`` pages ask the service they come from for plans to clicked points."""
    scene = scene | {"live": live}
    title = str(scene["map_name"]).replace("&", "&amp;").replace("<", "&lt;")
    return _PAGE % {"title": title, "data": json.dumps(scene).replace("</", "<\\/")}
