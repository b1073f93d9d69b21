from emberlog.cli import main

raise SystemExit(main())
