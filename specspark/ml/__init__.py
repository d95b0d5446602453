"""Classical baselines as MLlib pipelines."""
