"""Jobs for clusters: each reads tables, uses the library, writes partitioned tables, and can be run again."""
