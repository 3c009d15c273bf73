from quarrylog.cli import main

raise SystemExit(main())
