"""Model layers: staging, intermediate, marts, reports, quality, warehouse (build_all)."""
