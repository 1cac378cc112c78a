"""Plans that put operators together: marts, metrics, saved questions, the pipeline."""
