"""Operators on contact maps and tracks.

Tables: cells (map, binsize, i, j, v), both triangles of a symmetric map, zeros absent;
bins (map, binsize, i, no_data); track (chrom, binsize, name, bin, v).
"""
