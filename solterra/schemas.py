"""Schemas of the tables that the operators take and give."""

RASTER = "raster_id long, n_rows int, n_cols int, x_min double, y_max double, dx double, dy double, crs string, vals array<double>, info map<string,string>"
VERTEX = "mesh_id long, vid long, x double, y double, z double"
FACE = "mesh_id long, fid long, v0 long, v1 long, v2 long"
POINT = "pid long, x double, y double"
POLYGON = "poly_id long, rings array<struct<part:int,hole:boolean,pts:array<struct<x:double,y:double>>>>"
EDGE = "poly_id long, part int, hole boolean, k int, x0 double, y0 double, x1 double, y1 double"
